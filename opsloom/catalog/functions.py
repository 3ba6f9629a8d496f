"""Queries of the user-function family."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from opsloom.catalog.registry import query
from opsloom.functions import user as U


@query(
    "f1_scalar_function",
    "SELECT p_partkey, upper(substr(p_name, 1, 3)) || p_size AS code, round(p_retailprice * 1.2 + p_size, 4) AS gross FROM part",
)
def _(t):
    def short(name: pd.Series, size: pd.Series) -> pd.Series:
        return name.str[:3].str.upper() + size.astype(str)

    code = U.register(t.spark, "short_code", short, "string")
    U.register_sql(t.spark, "gross_price", "price DOUBLE, size INT", "DOUBLE", "round(price * 1.2D + size, 4)")
    return t.part.select("p_partkey", code("p_name", "p_size").alias("code"), F.expr("gross_price(p_retailprice, p_size)").alias("gross"))


@query("f2_batch_function", "SELECT event_id, round(value * 2 + user_id, 4) AS score FROM events WHERE event_type <> 'view'")
def _(t):
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["event_type"] != "view"]
        return pd.DataFrame({"event_id": pdf["event_id"], "score": pdf["value"] * 2 + pdf["user_id"]})

    rows = t.events.select("event_id", "event_type", "value", "user_id")
    return U.apply_function(rows, score, "event_id bigint, score double").withColumn("score", F.round("score", 4))


@query("f3_user_aggregate", "SELECT o_orderpriority, round(exp(avg(ln(o_totalprice))), 4) AS geometric_mean FROM orders GROUP BY 1")
def _(t):
    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(s=np.log(pdf["o_totalprice"]))
        return pdf.groupby("o_orderpriority", dropna=False).agg(s=("s", "sum"), n=("s", "count")).reset_index()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_orderpriority": pdf["o_orderpriority"].iloc[:1], "s": [pdf["s"].sum()], "n": [pdf["n"].sum()]})

    mean = F.round(F.exp(F.try_divide("s", "n")), 4)
    return U.aggregate_with(
        t.orders.select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], partial, merge, mean, "o_orderpriority string, s double, n bigint", "geometric_mean"
    )


class Lines:
    """Numbered non-empty lines of a text."""

    def eval(self, text: str):
        for i, line in enumerate((text or "").split("\n")):
            if line:
                yield i, line


@query(
    "f4_table_function",
    """SELECT doc_id, (i - 1)::INTEGER AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM
       (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE l[i] <> ''""",
)
def _(t):
    U.register_table_fn(t.spark, "numbered_lines", Lines, "line_no int, line string")
    return t.spark.sql("SELECT doc_id, line_no, line FROM {docs}, LATERAL numbered_lines(text)", docs=t.documents)
