"""The same sessions on a live stream."""
