"""Schemas of the index: six relations, and the nested record of one file that they are exploded from."""

from __future__ import annotations

from pyspark.sql import types as T

KINDS = ("function", "prototype", "global_variable", "typedef", "struct", "union", "enum", "enumerator", "macro", "label", "class",
         "namespace", "method", "field", "parameter")
ROLES = ("value", "type", "field", "label", "namespace")


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(),
          "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    """A struct of ``name type, …``, without a running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(", "))])


SYMBOL = _struct("ord int, name string, kind string, line int, col int, end_line int, end_col int, is_definition boolean, source string, "
                 "scope string, data_type string, decl_type string, signature string, return_type string, storage string, arity int, "
                 "param_types string")
REF = _struct("ord int, name string, line int, col int, enclosing_func string, is_local boolean, role string, owner string, "
              "obj_chain array<string>, source string")
CALL = _struct("ord int, caller string, callee string, line int, col int, source string")
LOCAL = _struct("ord int, name string, kind string, func string, line int, col int, end_line int, end_col int, data_type string, "
                "decl_type string")
ALIAS = _struct("ord int, name string, target string")
FILE_INDEX = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("mtime", T.LongType()),
    T.StructField("parsed_by", T.StringType()), T.StructField("parse_error", T.StringType()),
    T.StructField("symbols", T.ArrayType(SYMBOL)), T.StructField("refs", T.ArrayType(REF)), T.StructField("calls", T.ArrayType(CALL)),
    T.StructField("locals", T.ArrayType(LOCAL)), T.StructField("aliases", T.ArrayType(ALIAS)),
])
FACTS = ("symbols", "refs", "calls", "locals", "aliases")
