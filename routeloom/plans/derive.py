"""Relations of code derived from the driver's tables, so that operators run at any scale factor.

regions mount nations, nations hold the routes of customers and suppliers, orders call
them, events are the steps of flows, parts are files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mounts(spark, sf_dir) -> DataFrame:
    """app -> region routers -> nation routers. Region 4's router resolves nowhere; every seventh nation is not mounted."""
    regions = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("long").alias("mount_id"), F.lit("app").alias("parent"),
        F.when(F.col("r_regionkey") != 4, F.concat(F.lit("region:"), "r_regionkey")).alias("child"), F.concat(F.lit("/"), F.lower("r_name"), F.lit("/")).alias("prefix"),
    )
    nations = table(spark, sf_dir, "nation").filter("n_nationkey % 7 <> 3").select(
        (F.col("n_nationkey") + 100).cast("long").alias("mount_id"), F.concat(F.lit("region:"), "n_regionkey").alias("parent"),
        F.concat(F.lit("nation:"), "n_nationkey").alias("child"), F.concat(F.lit("//"), F.lower("n_name")).alias("prefix"),
    )
    return regions.unionByName(nations)



def _routes(df: DataFrame, key: str, nation: str, balance: str, stem: str, offset: int) -> DataFrame:
    k = F.col(key)
    verb = F.element_at(F.array(*map(F.lit, ("get", "post", "put", "delete"))), (k % 4 + 1).cast("int"))
    path = (
        F.when(k % 3 == 0, F.concat(F.lit(f"/{stem}/:id/"), (k % 50).cast("string")))
        .when(k % 3 == 1, F.concat(F.lit(f"/{stem}/<int:id>/"), (k % 50).cast("string")))
        .otherwise(F.concat(F.lit(f"{stem}/"), (k % 50).cast("string"), F.lit("/")))
    )
    file = F.when(k % 17 == 0, F.concat(F.lit("tests/test_"), (k % 5).cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("src/nation_"), F.col(nation), F.lit(".py")))
    label = F.when(k % 5 == 0, F.concat(F.lit("@app."), verb, F.lit("('/x')"))).when(k % 5 == 1, F.concat(F.lit("client."), verb, F.lit("('/x')"))).otherwise(F.lit("seen"))
    return df.select(
        (k + offset).alias("ord"), verb.alias("method"), path.alias("path"),
        F.when(k % 13 != 0, F.concat(F.lit(f"{stem}_handler_"), (k % 20).cast("string"))).alias("handler"), file.alias("file"), F.lit(f"{stem}-repo").alias("repo"),
        F.when(k % 6 != 0, F.concat(F.lit("svc"), F.col(nation))).alias("service"),
        F.when(k % 11 != 0, F.round((F.col(balance) + 1000) / 11000, 2)).alias("confidence"),
        F.when(k % 5 == 0, "deterministic").when(k % 5 != 1, "llm").alias("status"),
        F.array(F.struct(file.alias("file"), F.lit(None).cast("string").alias("symbol"), label.alias("label"), F.lit(None).cast("string").alias("snippet"))).alias("evidence"),
        F.concat(F.lit("nation:"), F.col(nation)).alias("container"),
    )


def endpoints(spark, sf_dir) -> DataFrame:
    """Route candidates: customers in one repo, suppliers in another, in several spellings, with repeats."""
    c = _routes(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_acctbal", "customers", 0)
    s = _routes(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "s_acctbal", "suppliers", 100_000_000)
    return c.unionByName(s)


def calls(spark, sf_dir) -> DataFrame:
    """Outbound calls from orders: URLs and paths with noise, some without method, some to nowhere."""
    k, n = F.col("o_orderkey"), (F.col("o_custkey") % 50).cast("string")
    target = (
        F.when(k % 5 == 0, F.concat(F.lit("https://api.svc"), (k % 25).cast("string"), F.lit(".example.com/customers/"), n, F.lit("?q=1#top")))
        .when(k % 5 == 1, F.concat(F.lit("//customers//"), n, F.lit("/")))
        .when(k % 5 == 2, F.concat(F.lit("'/suppliers/"), n, F.lit("'")))
        .when(k % 5 == 3, F.concat(F.lit("/nowhere/"), n))
    )
    verb = F.when(k % 4 == 0, "GET").when(k % 4 == 1, "requests.put").when(k % 4 == 2, "head")
    return table(spark, sf_dir, "orders").select(
        k.alias("call_id"), verb.alias("method"), target.alias("path"), F.when(k % 3 == 0, F.concat(F.lit(" Svc"), (k % 25).cast("string"))).alias("service"),
        F.when(k % 7 != 0, F.round((k % 10) / 10.0, 1)).alias("confidence"),
    )


def steps(spark, sf_dir) -> DataFrame:
    """Steps of flows: a user's events in order of time."""
    kind = F.when(F.col("event_type") == "purchase", "db_write").when(F.col("event_type") == "view", "return").when(F.col("event_type") == "error", "branch").when(F.col("event_type") == "click", "await_call").otherwise("signup")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("flow_id"), F.col("event_id").alias("ord"), "ts", "event_type", kind.alias("kind"), "value", "props")


def files(spark, sf_dir) -> DataFrame:
    """Files of repositories: parts by brand."""
    k = F.col("p_partkey")
    stem = F.element_at(F.array(*map(F.lit, ("src/routes/user", "app/main", "tests/test_api", "docs/guide", "lib/util", "api/controllers/item", "server", "pkg/view_model"))), (k % 8 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".js", ".md", ".go", ".java", "", ".test.ts", ".rb"))), (k % 9 + 1).cast("int"))
    number = F.when(k % 4 != 0, F.concat(F.lit("_"), (k % 100).cast("string"))).otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.concat(stem, number, ext).alias("path"), F.col("p_size").cast("long").alias("size"), k.alias("ord"))
