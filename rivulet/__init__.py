"""rivulet — feed analytics on Spark.

Feed documents, pages and interaction events are read as DataFrames or
streams; entries are conformed to typed tables with stable hashed keys,
cleaned, validated (bad rows set aside), scored and upserted by key.
Everything is expressed with the DataFrame / SQL / Structured Streaming
APIs so Catalyst plans the work.
"""

__version__ = "0.1.0"
