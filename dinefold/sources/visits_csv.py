"""Visit feedback files: UTF-8 CSV, with or without a byte order mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dinefold.functions.cells import parse_time

# Header words and the column each becomes.
COLUMNS = {
    "订单号": ("order_no", "string"),
    "店面": ("store", "string"),
    "桌台号": ("table_name", "string"),
    "就餐人数": ("guests", "int"),
    "支付金额": ("paid", "decimal(18,2)"),
    "下单时间": ("order_time", "time"),
    "服务员": ("waiter", "string"),
    "会员状态": ("member_status", "string"),
    "语音转录": ("transcript", "string"),
    "总体满意度评分": ("satisfaction", "double"),
    "创建时间": ("created_at", "time"),
}
BOM = "﻿"


def read_visits(spark: SparkSession, paths) -> DataFrame:
    """Visits of one or more files with the same header; columns are found by header word.

    Files with another header are refused by the reader: read them in a call of their own.
    Transcripts may hold line breaks. The mark before the first name is stripped, numbers
    and times that do not parse become null.
    """
    raw = spark.read.csv(paths, header=True, multiLine=True, escape='"', enforceSchema=False)
    by_name = {c.replace(BOM, "").strip(): c for c in raw.columns}
    out = []
    for header, (name, kind) in COLUMNS.items():
        if header not in by_name:
            out.append(F.lit(None).cast("timestamp_ntz" if kind == "time" else kind).alias(name))
            continue
        c = F.col(f"`{by_name[header]}`")
        out.append((parse_time(c) if kind == "time" else c.try_cast(kind)).alias(name))
    return raw.select(*out, F.col("_metadata.file_name").alias("source_file"))
