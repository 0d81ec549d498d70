"""stayguard: revenue-at-risk analytics for reservation tables, on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column``)
function built from the public DataFrame / SQL / ML / Structured Streaming API.
"""

__version__ = "0.1.0"
