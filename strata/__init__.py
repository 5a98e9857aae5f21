"""strata: layout-aware analytics operators written as plain Spark DataFrame code.

Sub-packages
------------
sources    readers and writers (edge lists, points, LIBSVM, vector text/JSON, documents, cluster models)
functions  column expressions (vector math, hashing, numerics) that stay inside the JVM
operators  DataFrame -> DataFrame operators (text, vectors, layouts, linear algebra, graph, sampling)
plans      iterative jobs built from operators (k-means, PageRank, BFS / Pregel, decision tree)
streaming  the stateless operators applied to Structured Streaming sources
"""

__version__ = "0.1.0"
