"""Streaming: the reference has no streaming operators (no watermark, window,
state or late-data code; every input is a finite table), so nothing is built
here.  Every operator in this package is a DataFrame -> DataFrame transform;
the stateless ones (column functions, fitted transforms) can be applied to a
streaming DataFrame unchanged, while fits need a bounded table.
"""
