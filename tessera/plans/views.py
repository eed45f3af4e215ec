"""Adapter views: the engine's input tables as SQL over the driver's tables.

The same text runs in Spark (tables as ``{name}``) and, as common table
expressions, in DuckDB.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "px": """SELECT CAST(l_partkey AS BIGINT) AS cell_id, CAST(l_linenumber % 3 AS INT) AS stain,
 CASE l_returnflag WHEN 'A' THEN 'nuc' WHEN 'N' THEN 'cyto' ELSE 'mem' END AS comp,
 CAST(l_quantity * 5 AS INT) AS v_aec, CAST(ROUND(l_discount * 2500) AS INT) AS v_hema FROM {lineitem}""",
    "cells": """SELECT cell_id, CAST(FLOOR(y / 1000.0) * 4 + FLOOR(x / 1000.0) AS INT) AS tile_index, y, x FROM
 (SELECT p_partkey AS cell_id, CAST((p_partkey * 7919) % 3989 AS INT) AS y, CAST((p_partkey * 104729) % 3967 AS INT) AS x FROM {part}) t""",
    "det": """SELECT o_orderkey AS det_id, CAST(o_orderkey % 3 AS INT) AS stain,
 CAST((o_custkey * 7919) % 3989 + o_orderkey % 7 - 3 AS DOUBLE) AS cy, CAST((o_custkey * 104729) % 3967 + o_orderkey % 5 - 2 AS DOUBLE) AS cx FROM {orders}""",
    "tilestats": """SELECT tile_index, CAST(15 + (tile_index * 37) % 85 AS DOUBLE) AS tissue_pct,
 (15 + (tile_index * 37) % 85) / 100.0E0 * 1020 * 1020 * 0.5031E0 * 0.5031E0 AS tissue_area_um2,
 CAST(FLOOR(tile_index / 4.0) * 1000 AS INT) AS y0, CAST((tile_index % 4) * 1000 AS INT) AS x0 FROM (SELECT DISTINCT tile_index FROM {cells}) t""",
    "cellinfo": """SELECT c.cell_id, c.tile_index, c.y, c.x, CAST(p.p_size % 7 AS INT) AS m1_tier, CAST((p.p_partkey * 31) % 7 AS INT) AS m2_tier,
 (p.p_size % 7) >= 4 AS m1_expression, ((p.p_partkey * 31) % 7) >= 5 AS m2_expression FROM {cells} c JOIN {part} p ON p.p_partkey = c.cell_id""",
    "ann": """SELECT n_nationkey AS ann_id, r_name AS name, CAST((n_nationkey * 613) % 3000 AS INT) AS x_min, CAST((n_nationkey * 997) % 3000 AS INT) AS y_min,
 CAST((n_nationkey * 613) % 3000 + 300 + (n_nationkey * 97) % 600 AS INT) AS x_max, CAST((n_nationkey * 997) % 3000 + 300 + (n_nationkey * 89) % 600 AS INT) AS y_max
 FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "ann_nested": """SELECT ann_id, name, x_min, y_min, x_max, y_max FROM {ann}
 UNION ALL SELECT ann_id + 100, name, x_min + 50, y_min + 50, x_max - 50, y_max - 50 FROM {ann} WHERE ann_id % 2 = 0""",
    # Outlines that are no boxes: a triangle, an L, and a box with a hole, by ann_id % 3; a and b are half the sides.
    "outline": """SELECT ann_id, name, ann_id % 3 AS kind, x_min, y_min, x_max, y_max, CAST(FLOOR((x_max - x_min) / 2.0E0) AS INT) AS a, CAST(FLOOR((y_max - y_min) / 2.0E0) AS INT) AS b FROM {ann}""",
    "feat": "SELECT vec_id, label, embedding FROM {embeddings}",
    # Pixel shapes of cells, a small image with an autofluorescence channel, and a thumbnail tissue mask.
    "shape": "SELECT DISTINCT l_partkey AS cell_id, CAST(l_linenumber AS INT) AS y, CAST(l_quantity AS INT) % 6 AS x FROM {lineitem}",
    "img": """SELECT CAST(l_orderkey % 41 AS INT) AS y, CAST(l_partkey % 53 AS INT) AS x, CAST(MAX(l_quantity * 5) AS INT) AS v,
 CAST(MIN(l_discount * 2500) AS INT) AS af FROM {lineitem} WHERE l_linenumber <> 3 GROUP BY l_orderkey % 41, l_partkey % 53""",
    "mask": "SELECT DISTINCT CAST((l_orderkey * 3) % 127 AS INT) AS ty, CAST((l_partkey * 5) % 131 AS INT) AS tx FROM {lineitem} WHERE l_quantity > 8",
}


class Views:
    """Tables and adapter views of one data folder, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @functools.lru_cache(maxsize=None)  # noqa: B019
    def __getitem__(self, name: str) -> DataFrame:
        if name not in SQL:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        used = dict.fromkeys(re.findall(r"\{(\w+)\}", SQL[name]))
        return self.spark.sql(SQL[name], **{n: self[n] for n in used})


def with_views(body: str) -> str:
    """``body`` for DuckDB, with the views it names as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(SQL[name].replace("{", " ").replace("}", " "))
                if name not in needed:
                    needed.append(name)

    need(body)
    ctes = [f"{n} AS ({re.sub(r'[{}]', '', SQL[n])})" for n in needed]
    body = body.strip()
    if not ctes:
        return body
    head = "WITH "
    if re.match(r"WITH RECURSIVE\b", body):
        head, body = "WITH RECURSIVE ", body[len("WITH RECURSIVE") :]
        return f"{head}{', '.join(ctes)}, {body}"
    return f"{head}{', '.join(ctes)}, {body[4:]}" if re.match(r"WITH\b", body) else f"{head}{', '.join(ctes)} {body}"
