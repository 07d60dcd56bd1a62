"""Capture, key-state, dispatch, sink and statistics operators over a change log."""
