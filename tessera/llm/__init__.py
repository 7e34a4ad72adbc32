"""Training-data pipeline operators.

Each module holds one operator with a general DataFrame-in, DataFrame-out
interface; :mod:`tessera.llm.queries` derives the registered queries from them.
Nothing outside this subpackage imports it.
"""
