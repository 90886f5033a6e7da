"""Files that the source queries read, made from the given tables by Spark tasks."""

from __future__ import annotations

import zipfile

from pyspark.sql import DataFrame, functions as F

import millrace as mr
from millrace.sources.files import create_file

from .registry import Tables

COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
           "o_orderpriority"]


def raw_lines(df: DataFrame, header: str, line, path: str) -> None:
    """Write ``line`` unquoted, under ``header`` at the top of every part file."""
    (df.select(line.alias(header)).write.option("header", True).option("sep", "\u0001")
     .option("quote", "").csv(path))


def zip_orders(t: Tables) -> str:
    """One archive per month of orders: ``data/orders.csv``, ``priorities.csv``, ``notes.sql``."""
    import pandas as pd

    path = mr.scratch_path(t.spark, "zips")
    rows = t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = rows.withColumn("archive", F.concat(F.substring("o_orderdate", 1, 7), F.lit(".zip")))
    lines = rows.select("archive", F.lit("data/orders.csv").alias("member"),
                        F.to_csv(F.struct(*COLUMNS)).alias("line"))
    ranks = rows.select("archive", "o_orderpriority").distinct().select(
        "archive", F.lit("priorities.csv").alias("member"),
        F.concat_ws(",", "o_orderpriority", F.substring("o_orderpriority", 1, 1)).alias("line"))
    heads = rows.select("archive").distinct().select("archive", F.inline(F.array(*[
        F.struct(F.lit(m).alias("member"), F.lit(h).alias("line")) for m, h in (
            ("data/orders.csv", ",".join(COLUMNS)), ("priorities.csv", "o_orderpriority,rank"),
            ("notes.sql", "select 1"))])))
    body = (heads.withColumn("at", F.lit(0))
            .unionAll(lines.withColumn("at", F.lit(1))).unionAll(ranks.withColumn("at", F.lit(1))))

    def pack(batches):
        """Stream sorted lines into archives; one is open at a time."""
        name = archive = out = inner = None

        def close():
            if archive:
                inner.close()
                archive.close()
                out.close()

        for batch in batches:
            for zip_name, member, chunk in (
                    (*key, group) for key, group in batch.groupby(["archive", "member"], sort=False)):
                if archive is None or name[0] != zip_name:
                    close()
                    out = create_file(f"{path}/{zip_name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    inner = archive.open(member, "w", force_zip64=True)
                elif name[1] != member:
                    inner.close()
                    inner = archive.open(member, "w", force_zip64=True)
                name = (zip_name, member)
                inner.write("".join(line + "\n" for line in chunk["line"]).encode())
        close()
        yield pd.DataFrame({"done": [1]})

    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    packed = (body.repartition(n, "archive").sortWithinPartitions("archive", "member", "at")
              .select("archive", "member", "line").mapInPandas(pack, "done int"))
    packed.write.format("noop").mode("overwrite").save()
    return path


def mixed_folder(t: Tables) -> str:
    """A folder with semicolon text, comma text and Parquet files of different columns."""
    path = mr.scratch_path(t.spark, "folder")
    text = {"header": True, "mode": "append"}
    t.customer.select("c_custkey", "c_name", "c_acctbal").write.csv(path, sep=";", **text)
    t.supplier.select("s_suppkey", "s_name").write.csv(path, sep=",", **text)
    t.orders.select("o_orderkey", "o_orderstatus").write.parquet(path, mode="append")
    return path


def text_files(files: DataFrame, path: str, encoding: str = "utf-8") -> str:
    """Write each row's ``text`` as the file ``path/name``, by Spark tasks."""
    def run(batches):
        for batch in batches:
            for name, text in zip(batch["name"], batch["text"]):
                with create_file(f"{path}/{name}") as out:
                    out.write(text.encode(encoding))
            yield batch[["name"]]

    files.select("name", "text").mapInPandas(run, "name string").write.format("noop").mode(
        "overwrite").save()
    return path


def in_hundreds(df: DataFrame, key: str, line, name: str, head: str = "", tail: str = "",
                between: str = "\n") -> DataFrame:
    """Files of at most a hundred keys each: the rows' lines, in order of key, as one text."""
    rows = df.select(F.floor(F.col(key) / 100).alias("part"), F.struct(key, line.alias("line"))
                     .alias("row"))
    return rows.groupBy("part").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        F.format_string(name, "part").alias("name"), F.concat(
            F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), between),
            F.lit(tail)).alias("text"))


def zip_files(members: DataFrame, path: str) -> str:
    """Write rows (archive, member, text) as ZIP archives below ``path``, one task an archive.

    Texts are in UTF-8, or in the ``encoding`` that their rows name.
    """
    import pandas as pd

    def pack(key, batch: pd.DataFrame) -> pd.DataFrame:
        with create_file(f"{path}/{key[0]}") as out, zipfile.ZipFile(out, "w") as z:
            for member, text, encoding in sorted(zip(batch["member"], batch["text"], batch["encoding"])):
                z.writestr(member, text.encode(encoding))
        return pd.DataFrame({"done": [1]})

    if "encoding" not in members.columns:
        members = members.withColumn("encoding", F.lit("utf-8"))
    members.groupBy("archive").applyInPandas(pack, "done int").write.format("noop").mode(
        "overwrite").save()
    return path
