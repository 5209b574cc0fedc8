"""Training-data operators. Nothing outside this subpackage imports it.

Every operator takes a DataFrame and returns one; `queries` derives the
contract rows from them. Functions that run in Python workers are module
functions, so on a cluster ship the package with ``spark.submit.pyFiles``.
"""
