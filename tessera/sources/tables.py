"""Scans and sinks of tables and metadata (CSV, JSON, YAML, text, listings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header and a given schema."""
    return spark.read.schema(schema).csv(path, header=True)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features, from a ``features`` list or a bare one."""
    text = spark.read.text(path, wholetext=True)
    feature = "array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    whole = F.from_json(F.get_json_object("value", "$.features"), feature)
    return text.select(F.explode(F.coalesce(whole, F.from_json("value", feature))).alias("f")).select("f.*")


def parse_parameters(text: str) -> dict:
    """Settings of a YAML text (A8), none if it is empty."""
    import yaml

    return yaml.safe_load(text) or {}


def read_parameters(path: str) -> dict:
    """A YAML file's settings (A8); configuration is read once, at the driver."""
    with open(path, encoding="utf-8") as f:
        return parse_parameters(f.read())


def parameter(settings: dict, name: str):
    """The first section's value of a nested key."""
    for section in settings.values():
        if isinstance(section, dict) and name in section:
            return section[name]
    return settings.get(name)


def ome_dpi(xml: Column) -> Column:
    """Dots per inch from OME-XML pixel sizes (A4), null for unknown units."""
    size = F.regexp_extract(xml, r'PhysicalSizeX="([^"]+)"', 1).try_cast("double")
    unit = F.regexp_extract(xml, r'PhysicalSizeXUnit="([^"]+)"', 1)
    return F.when(unit.isin("µm", "um", ""), 25400 / size).when(unit == "mm", 25.4 / size)


def ome_tile(xml: Column, default: int = 1024) -> Column:
    """Tile width from OME-XML (A4)."""
    return F.coalesce(F.regexp_extract(xml, r'TileWidth="(\d+)"', 1).try_cast("int"), F.lit(default))


def slide_metadata(slides: DataFrame) -> DataFrame:
    """Micrometres per pixel and size at a magnification (A5)."""
    return slides.withColumns({"um_per_px": F.col("mm_x") * 1000, "res": F.round(F.col("magnification")).cast("int")})


def find_slide(paths: DataFrame, marker: str, sample: str) -> DataFrame:
    """The first slide file (by path) that names marker and sample."""
    low = F.lower("path")
    hit = F.contains(low, F.lit(marker.lower())) & F.contains(low, F.lit(sample.lower())) & low.rlike(r"\.(svs|ndpi)$")
    return paths.where(hit).orderBy("path").limit(1)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """A directory's files, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("sample"))


def project_samples(spark: SparkSession, path: str) -> DataFrame:
    """A project's samples (A18): its direct folders, with or without files, by name."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(root)
    rows = [(f.getPath().getName(), f.getPath().toString()) for f in found if f.isDirectory()]
    return spark.createDataFrame(sorted(rows), "sample string, path string")


def write_tiles(metrics: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Metrics by sample and tile (A12); tiles without rows write nothing."""
    metrics.write.mode("overwrite").partitionBy("sample", "tile_index").format(fmt).save(path)


def cell_json(cells: DataFrame, columns: list[str]) -> DataFrame:
    """A JSON text per cell and its file's name."""
    name = F.format_string("%s_ROI#%d_%s.json", "sample", "tile_index", "marker")
    return cells.select("sample", "tile_index", "marker", name.alias("file"), F.to_json(F.struct(*columns)).alias("value"))


def write_cell_json(cells: DataFrame, columns: list[str], path: str) -> None:
    cell_json(cells, columns).select("tile_index", "marker", "value").write.mode("overwrite").partitionBy("tile_index", "marker").text(path)


def reviewer_copy(base: DataFrame, edits: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A reviewer's table (A16): the base under the reviewer's own rows."""
    mine = edits.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = base.join(mine, F.col(key) == F.col("_key"), "left")
    own = F.col("_key").isNotNull()  # an edit to null counts too
    return joined.withColumns({c: F.when(own, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_key", *[f"_{c}" for c in columns])
