"""Stateful streams: settled files, job state, device health, progress, trackers."""
