"""Queries written as JSON documents: find, aggregate, count, insert, update, delete, createCollection, dropCollection."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators import changes, documents
from ..plans.grammar import ParseError


def run(catalog: Catalog, query: str | dict) -> DataFrame:
    q = json.loads(query) if isinstance(query, str) else query
    verb = next((k for k in ("find", "aggregate", "count", "insert", "update", "delete", "createCollection", "dropCollection", "createIndex", "dropIndex", "distinct") if k in q), None)
    if verb is None:
        raise ParseError("json: use find, insert, update, delete, count or aggregate")
    name = q[verb]
    if verb == "dropCollection":
        catalog.drop(name)
    if verb in ("createCollection", "dropCollection", "createIndex", "dropIndex"):
        return catalog.show("collections")  # an index would change no result
    if verb == "insert":
        rows = q.get("documents") or [q["document"]]
        keys = list(dict.fromkeys(k for r in rows for k in r))
        new = catalog.spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], keys)
        new = changes.insert(catalog.frame(name), new) if name in catalog.tables else new
        catalog.replace(name, new)
        return new
    df, match = catalog.frame(name), documents.where(q.get("filter", {}))
    if verb == "aggregate":
        return documents.pipeline(df, q["pipeline"], catalog.frame)
    if verb == "count":
        return df.filter(match).agg(F.count("*").alias("count"))
    if verb == "distinct":
        return df.filter(match).select(q["field"]).distinct()
    if verb == "delete":
        new = changes.delete(df, match)
    elif verb == "update":
        new = changes.update(df, match, {k: F.lit(v) for k, v in q.get("set", {}).items()} | {k: F.lit(None) for k in q.get("unset", [])})
        if q.get("upsert") and df.filter(match).isEmpty():
            row = {k: v for k, v in q["filter"].items() if not isinstance(v, dict)} | q.get("set", {})
            new = changes.insert(new, catalog.spark.createDataFrame([tuple(row.values())], list(row)))
    else:
        stages: list[dict] = [{"$match": q.get("filter", {})}]
        stages += [{"$sort": q["sort"]}] if q.get("sort") else []
        stages += [{"$skip": n}] if (n := q.get("skip", q.get("offset", 0))) else []
        stages += [{"$limit": q["limit"]}] if q.get("limit") is not None else []
        stages += [{"$project": q["projection"]}] if q.get("projection") else []
        return documents.pipeline(df, stages, catalog.frame)
    catalog.replace(name, new)
    return new
