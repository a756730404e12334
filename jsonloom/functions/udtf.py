"""Table functions for SQL: ``json_tokens(json)`` and ``json_nodes(json)`` on valid documents."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\]:,]|[^ \t\n\r{}\[\]:,"]+', re.S)


@udtf(returnType="tok int, pos bigint, kind string, text string")
class JsonTokens:
    def eval(self, text: str):
        at, seen = 0, 0
        for i, m in enumerate(TOKEN.finditer(text or "")):
            seen += len(text[at : m.start()].encode())
            kind = m[0] if m[0] in "{}[]:," else "q" if m[0][0] == '"' else "s"
            yield i, seen, kind, m[0]
            seen += len(m[0].encode())
            at = m.end()


@udtf(returnType="node_id int, parent_id int, ordinal int, key string, kind string, value string")
class JsonNodes:
    def eval(self, text: str):
        open_nodes, key = [], None
        tokens = TOKEN.findall(text or "")
        for i, t in enumerate(tokens):
            if t in ("}", "]"):
                if not open_nodes:  # not a valid document; parse tells why
                    return
                open_nodes.pop()
            elif t[0] == '"' and tokens[i + 1 : i + 2] == [":"]:
                key = json.loads(t)
            elif t not in (":", ","):
                parent = open_nodes[-1] if open_nodes else None
                ordinal = None
                if parent:
                    ordinal, parent[1] = parent[1], parent[1] + 1
                kind = {"{": "object", "[": "array", '"': "string", "t": "bool", "f": "bool", "n": "null"}.get(t[0]) or self.number(t)
                value = None if t in ("{", "[", "null") else json.loads(t) if kind == "string" else t
                yield i, parent[0] if parent else None, ordinal, key, kind, value
                key = None
                if t in ("{", "["):
                    open_nodes.append([i, 0])

    @staticmethod
    def number(t: str) -> str:
        if re.search("[.eE]", t) or not -(2**63) <= int(t) < 2**64:
            return "double"
        return "int64" if int(t) < 2**63 else "uint64"


def register(spark: SparkSession) -> None:
    spark.udtf.register("json_tokens", JsonTokens)
    spark.udtf.register("json_nodes", JsonNodes)
