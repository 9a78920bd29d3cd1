"""Allow and block lists over URLs by a trie of reversed host labels and path segments.

The list is a parameter of bounded size (``MAX_RULES``), so its trie is broadcast.  A rule fits its host
and all subdomains when the URL's path starts with the rule's path; of several fitting rules the longest
(host and path characters) wins, then the one with more host labels, then block.  Without a fitting rule
the verdict is ``default``.

A null URL, or one without ``://``, has an empty host and path and fits no rule.  Hosts keep a port or user
part as they stand.  Only the named columns are read; repeated rows give repeated results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postwarden.llm.common import ascii_lower, batch

MAX_RULES = 1_000_000


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested nodes from (verdict, host, path) rules.

    A host node has "labels" (next label to node) and "paths", the root of a path trie; a path node has
    "segments" (whole next segment to node) and "ends": (beginning of the next segment, rule) pairs.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    root: dict = {"labels": {}}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not path.startswith("/"):
            raise ValueError(f"not a rule: {verdict} {host}{path}")
        node, labels = root, [x for x in host.lower().split(".") if x]
        for label in reversed(labels):
            node = node["labels"].setdefault(label, {"labels": {}})
        node = node.setdefault("paths", {"segments": {}, "ends": []})
        *whole, last = path.split("/")
        for segment in whole:
            node = node["segments"].setdefault(segment, {"segments": {}, "ends": []})
        text = f"{host}{path}"
        node["ends"].append((last, (len(text), len(labels), verdict == "block", text, verdict)))
    return root


def longest(trie: dict, host: str, path: str) -> tuple | None:
    """The best rule for a host and path."""
    best, segments = None, path.split("/")
    node = trie
    for label in [*reversed(host.split(".")), None]:
        at = node.get("paths")
        for segment in segments if at else ():
            for beginning, rule in at["ends"]:
                if segment.startswith(beginning) and (best is None or rule > best):
                    best = rule
            at = at["segments"].get(segment)
            if at is None:
                break
        node = node["labels"].get(label)
        if node is None:
            break
    return best


def judged(
    df: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Host, path, deciding rule and verdict of each row's URL."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(build_trie(rules))
    schema = pa.schema([
        (id_col, pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()),
    ])

    def run(batches):
        trie = shared.value
        for b in batches:
            found = [longest(trie, h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield batch(
                schema, b.column(0), b.column(1), b.column(2),
                [f and f[3] for f in found], [f[4] if f else default for f in found],
            )

    url = F.col(url_col)
    rest = F.when(F.locate("://", url) > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    parts = df.select(F.col(id_col).cast("bigint").alias(id_col), rest.alias("rest")).select(
        id_col,
        ascii_lower(F.regexp_extract("rest", r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    return parts.mapInArrow(run, f"{id_col} bigint, host string, path string, rule string, verdict string")
