"""The row-by-row lead steps on a stream."""
