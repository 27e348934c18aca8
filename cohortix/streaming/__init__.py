"""Streaming: nothing to build.

The analyses this engine reproduces read bounded tables only -- no stream
source, watermark, session window or keyed state appears in them -- so every
pipeline is a batch DataFrame function.  Because the pipelines are plain
DataFrame -> DataFrame functions, a caller can still apply one inside
``writeStream.foreachBatch`` without changes.
"""
