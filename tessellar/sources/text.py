"""Text sources and sinks: line protocol, metric lines, exposition format, and result formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = {"ns": 1_000, "n": 1_000, "us": 1, "u": 1, "ms": None, "s": None, "m": None, "h": None}
_MULTIPLE = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}

# `key` up to the first unescaped blank; blanks and commas may be escaped or, in field values, quoted.
_LINE = r'^((?:[^\\ ]|\\.)+) ((?:[^\\ "]|\\.|"(?:[^"\\]|\\.)*")+)(?: (-?\d+))?\s*$'


def _pairs(text: Column, quoted: bool) -> Column:
    """A map of the pairs. Text without quotes or escapes is split plainly, the rest piece by piece."""
    plain = F.map_filter(F.str_to_map(text, F.lit(","), F.lit("=")), lambda k, v: v.isNotNull() & (k != ""))
    return F.when(text.contains("\\") | text.contains('"'), _escaped_pairs(text, quoted)).otherwise(plain)


def _escaped_pairs(text: Column, quoted: bool) -> Column:
    piece = r'((?:[^\\,="]|\\.)+=(?:[^\\,"]|\\.|"(?:[^"\\]|\\.)*")*)' if quoted else r"((?:[^\\,=]|\\.)+=(?:[^\\,]|\\.)*)"
    found = F.regexp_extract_all(text, F.lit(piece), F.lit(1))
    key = lambda x: F.regexp_replace(F.regexp_extract(x, r"^((?:[^\\=]|\\.)+)=", 1), r"\\(.)", "$1")
    value = lambda x: F.regexp_extract(x, r"^(?:[^\\=]|\\.)+=(.*)$", 1)
    return F.map_from_entries(F.transform(found, lambda x: F.struct(key(x), value(x) if quoted else F.regexp_replace(value(x), r"\\(.)", "$1"))))


def line_protocol(lines: DataFrame, precision: str = "ns", text_col: str = "value") -> DataFrame:
    """measurement, tags, fields (as written), ts_us from lines such as `cpu,host=a usage=0.5,ok=t 1609459200000000000`.

    Comments and blank lines are skipped. A line that fits no rule has a null measurement and its text in `bad`.
    """
    if precision not in PRECISION:
        raise ValueError(f"unknown precision {precision}")
    line = F.trim(text_col)
    rows = lines.filter(F.length(line) > 0).filter(~F.substring(line, 1, 1).eqNullSafe("#")).select(line.alias("_l"))
    # One match a line: its three parts, with a sign between them that no line may hold; a line without a match has one.
    rows = rows.select("_l", F.split(F.regexp_replace("_l", _LINE, "$1\u0001$2\u0001$3"), "\u0001").alias("_p"))
    part = lambda n: F.get("_p", F.lit(n - 1))
    ok = (F.size("_p") == 3) & F.col("_l").contains("=") & ~F.col("_l").contains("\u0001")
    raw = F.when(part(3) != "", part(3).cast("long"))
    us = F.call_function("div", raw - F.pmod(raw, F.lit(1000)), F.lit(1000)) if PRECISION[precision] == 1_000 else raw if precision in ("us", "u") else raw * _MULTIPLE[precision]
    escaped = part(1).contains("\\")
    name = F.when(escaped, F.regexp_replace(F.regexp_extract(part(1), r"^((?:[^\\,]|\\.)+)", 1), r"\\(.)", "$1")).otherwise(F.substring_index(part(1), ",", 1))
    tags = F.when(escaped, F.regexp_replace(part(1), r"^(?:[^\\,]|\\.)+,?", "")).otherwise(F.substring(part(1), F.length(F.substring_index(part(1), ",", 1)) + 2, F.length(part(1))))
    return rows.select(F.when(ok, name).alias("measurement"), F.when(ok, _pairs(tags, False)).alias("tags"), F.when(ok, _pairs(part(2), True)).alias("fields"), F.when(ok, us.cast("long")).alias("ts_us"), F.when(~ok, F.col("_l")).alias("bad"))


def field_value(fields: Column, name: str, kind: str = "double") -> Column:
    """A field by name: numbers (with i or u endings), truth values or quoted text."""
    v = fields[name]
    if kind == "string":
        return F.regexp_replace(F.regexp_replace(v, r'^"|"$', ""), r'\\(["\\])', "$1")
    if kind == "boolean":
        return F.when(F.lower(v).isin("t", "true"), True).when(F.lower(v).isin("f", "false"), False)
    return F.regexp_replace(v, "[iu]$", "").try_cast(kind)


def to_line_protocol(df: DataFrame, measurement: str, tags: list[str], fields: list[str], ts_us: Column) -> DataFrame:
    """Lines in nanoseconds. Nulls are left out."""
    esc = lambda c: F.regexp_replace(c.cast("string"), r"([ ,=\\])", r"\\$1")
    head = F.concat_ws(",", F.lit(measurement), *[F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{t}="), esc(F.col(t)))) for t in sorted(tags)])
    kinds = dict(df.dtypes)
    body = []
    for f in fields:
        c = F.col(f)
        text = F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"')) if kinds[f] == "string" else F.concat(c.cast("string"), F.lit("i" if kinds[f] in ("int", "bigint") else ""))
        body.append(F.when(c.isNotNull(), F.concat(F.lit(f"{f}="), text)))
    return df.select(F.concat_ws(" ", head, F.concat_ws(",", *body), (ts_us * 1000).cast("string")).alias("value"))


def put_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """`put metric seconds value tag=v ...`: metric, ts_us, value, tags. Times over 1e11 are milliseconds."""
    p = F.split(F.trim(text_col), r"\s+")
    t = F.get(p, F.lit(2)).try_cast("long")
    tags = F.map_from_entries(F.transform(F.slice(p, 5, F.greatest(F.size(p) - 4, F.lit(0))), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)), F.split_part(x, F.lit("="), F.lit(2)))))
    return lines.filter(F.get(p, F.lit(0)) == "put").select(F.get(p, F.lit(1)).alias("metric"), F.when(t > 10**11, t * 1000).otherwise(t * 1_000_000).alias("ts_us"), F.get(p, F.lit(3)).try_cast("double").alias("value"), tags.alias("tags"))


def put_json(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """One JSON object or array of them a line: {metric, timestamp, value, tags}."""
    one = "struct<metric:string,timestamp:bigint,value:double,tags:map<string,string>>"
    rows = lines.select(F.explode(F.when(F.trim(text_col).startswith("["), F.from_json(text_col, f"array<{one}>")).otherwise(F.array(F.from_json(text_col, one)))).alias("r"))
    t = F.col("r.timestamp")
    return rows.select("r.metric", F.when(t > 10**11, t * 1000).otherwise(t * 1_000_000).alias("ts_us"), "r.value", "r.tags")


def exposition(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Metric lines `name{a="b"} value [milliseconds]`: name, labels, value, ts_us. Comments are skipped."""
    rule = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"
    part = lambda n: F.regexp_extract(text_col, rule, n)
    pairs = F.regexp_extract_all(part(2), F.lit(r'(\w+="(?:[^"\\]|\\.)*")'), F.lit(1))
    labels = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)=", 1), F.regexp_replace(F.regexp_extract(x, r'^\w+="(.*)"$', 1), r"\\(.)", "$1"))))
    value = F.when(part(3).isin("+Inf", "Inf"), F.lit(float("inf"))).when(part(3) == "-Inf", F.lit(float("-inf"))).otherwise(part(3).try_cast("double"))
    return lines.filter(~F.col(text_col).startswith("#") & F.col(text_col).rlike(rule)).select(part(1).alias("name"), labels.alias("labels"), value.alias("value"), F.when(part(4) != "", part(4).cast("long") * 1000).alias("ts_us"))


def formatted(df: DataFrame, kind: str) -> DataFrame:
    """Rows as text: json (one object a row), csv or tsv (without header; see header())."""
    cols = df.columns
    if kind == "json":
        return df.select(F.to_json(F.struct(*cols)).alias("value"))
    if kind == "csv":
        return df.select(F.to_csv(F.struct(*cols)).alias("value"))
    if kind == "tsv":
        esc = lambda c: F.coalesce(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), "\t", r"\\t"), F.lit(r"\N"))
        return df.select(F.concat_ws("\t", *[esc(c) for c in cols]).alias("value"))
    raise ValueError(f"unknown format {kind}")


def header(df: DataFrame, kind: str) -> str:
    return {"csv": ",", "tsv": "\t"}[kind].join(df.columns)


def show(df: DataFrame, kind: str, rows: int | None = None) -> str:
    """All rows, or the first `rows`, as a table, Markdown, CSV or JSON text, for people."""
    import csv
    import io
    import json

    names, data = df.columns, [list(r) for r in (df if rows is None else df.limit(rows)).collect()]
    cells = [["" if v is None else str(v) for v in r] for r in data]
    if kind == "markdown":
        return "\n".join(["| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *cells]])
    if kind == "json":
        return json.dumps([dict(zip(names, r)) for r in data], default=str)
    if kind == "csv":
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([names, *cells])
        return out.getvalue()
    width = [max([len(n), *(len(r[k]) for r in cells)]) for k, n in enumerate(names)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in [names, ["-" * w for w in width], *cells])
