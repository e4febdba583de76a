"""Readers and writers: sorted runs, log files and text snapshots."""
