"""Lattiq: multi-vector retrieval and large-table data processing on PySpark.

Everything is expressed on DataFrames.  Sub-packages:

* ``sources``    readers and writers (NPY directories, metadata, corpora)
* ``functions``  column expressions and Arrow kernels (dot products, codecs)
* ``operators``  relational operators (salted aggregation, compaction, search)
* ``plans``      composed pipelines: index build, search, the engine facade
* ``streaming``  incremental ingestion on Structured Streaming
* ``llm``        optional operators for training-data preparation
"""

__version__ = "0.1.0"
