"""sparkloom: a PySpark-native toolkit for document collections.

Every operator takes and returns DataFrames and stays lazy unless its docstring says otherwise.
"""
