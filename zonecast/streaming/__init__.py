"""Intentionally without operators.

The feature set covers scheduled batch polling only: no watermark, stream window or stateful operator. Late
corrections are handled by the knowledge-time versions in ``zonecast.sources.bitemporal``.
"""
