"""Readers and writers: test tables, file trees, the event log, exports."""
