"""Small tables with the awkward cases, and DuckDB over them."""

import duckdb
import pyarrow as pa

DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
DOCS_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside, as columns of the input.
CLASHES = ["key", "node", "root", "band", "h", "_h", "sig", "rank", "_rank", "size", "state", "token_ids", "accepted", "predicted_lang", "good_probability", "virtual_finish", "n_tokens", "a.b"]


def documents(rows):
    """Rows (doc_id, text[, lang, source]) as full tuples."""
    return [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(documents(rows), DOCS_DDL)


def crowded(df):
    """df with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in df.columns])


def duck(sql, **tables):
    """Rows of the SQL as dicts."""
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return [dict(zip(names, r)) for r in cur.fetchall()]


def same_rows(a, b):
    """Whether two lists of dicts hold the same rows, in any order."""
    form = lambda rows: sorted(repr(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in r.items())) for r in rows)
    return form(a) == form(b)


def dicts(df):
    return [r.asDict() for r in df.collect()]
