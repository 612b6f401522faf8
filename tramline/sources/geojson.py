"""GeoJSON output: features as rows, and the collection as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions import geo
from tramline.operators.ordered import PART, PLACE, ranged

PIECE_ROWS = 50_000

_KEEP_NULLS = {"ignoreNullFields": "false"}
_OPEN, _CLOSE = '{"type": "FeatureCollection", "features": [', "]}"


def features(df: DataFrame, geometry: str, properties: list[str], schema: T.StructType) -> DataFrame:
    """``feature``: one GeoJSON Feature text per row; NULL properties are kept.

    ``geometry`` names a column of geometry text with the given schema.
    """
    value = F.struct(
        F.lit("Feature").alias("type"),
        F.from_json(geometry, schema).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    return df.select("*", F.to_json(value, _KEEP_NULLS).alias("feature"))


def point_features(df: DataFrame, properties: list[str]) -> DataFrame:
    return features(df, "geometry", properties, geo.POINT)


def line_features(df: DataFrame, properties: list[str]) -> DataFrame:
    return features(df, "geometry", properties, geo.LINE)


def write_collection(df: DataFrame, path: str, order: list) -> None:
    """Write a FeatureCollection as ordered text parts; concatenated in name order they are
    one document. No task ever holds the whole document.

    ``df`` has ``feature``; ``order`` names the columns that sort the features, NULLs last.
    """
    _write(df.select(*_keys(order), F.lit(0).cast("long").alias("_piece"), F.col("feature").alias("value")), path, len(order))


def write_lines(lines: DataFrame, vertices: DataFrame, properties: list[str], path: str, order: list, piece_rows: int = PIECE_ROWS) -> None:
    """The same for lines of any length: ``lines`` has ``shape_id`` and the properties, and
    ``vertices`` the vertex rows. A line's coordinates are written in pieces of about
    ``piece_rows`` vertices, so no row has to hold a whole line.

    A shape without vertices becomes a feature without geometry.
    """
    cut = ranged(vertices.select("shape_id", "seq", "ord", "lon", "lat"), ["shape_id"], ["seq", "ord"])
    cut = cut.withColumn("_slice", F.struct(PART, F.floor(F.col(PLACE) / piece_rows).alias("block")))
    pair = F.to_json(F.array(F.round("lon", 6), F.round("lat", 6)))
    texts = cut.withColumn("pair", pair).groupBy("shape_id", "_slice").agg(
        F.array_sort(F.collect_list(F.struct("seq", "ord", "pair"))).alias("v")
    )
    by_line = Window.partitionBy("shape_id").orderBy("_slice")
    pieces = texts.select(
        "shape_id",
        F.row_number().over(by_line).cast("long").alias("_piece"),
        F.array_join(F.transform("v", lambda v: v["pair"]), ",").alias("text"),
    )
    last = Window.partitionBy("shape_id")
    pieces = pieces.withColumn("_count", F.count("*").over(last))
    features = lines.select("shape_id", *_keys(order), F.to_json(F.struct(*properties), _KEEP_NULLS).alias("properties"))
    head, empty = '{"type":"Feature","geometry":{"type":"LineString","coordinates":[', '{"type":"Feature","geometry":null'
    piece = F.coalesce("_piece", F.lit(1).cast("long"))
    whole = F.concat(
        F.when(F.col("_piece").isNull(), F.lit(empty)).when(piece == 1, F.lit(head)).otherwise(F.lit(",")),
        F.coalesce("text", F.lit("")),
        F.when(F.col("_piece") == F.col("_count"), F.lit("]}")).otherwise(F.lit("")),
        F.when(F.coalesce(F.col("_piece") == F.col("_count"), F.lit(True)), F.concat(F.lit(',"properties":'), "properties", F.lit("}"))).otherwise(F.lit("")),
    )
    rows = features.join(pieces, "shape_id", "left").select(
        *[f"_k{i}" for i in range(len(order))], (piece - 1).alias("_piece"), whole.alias("value")
    )
    _write(rows, path, len(order))


def _keys(order: list) -> list:
    """The sort columns as ``_k0, _k1, …``; together they must tell features apart."""
    return [F.col(name).alias(f"_k{i}") for i, name in enumerate(order)]


def _write(rows: DataFrame, path: str, keys: int) -> None:
    """Sort the texts, put the collection around them and commas between features."""
    spark = rows.sparkSession
    sort = [F.asc_nulls_last(f"_k{i}") for i in range(keys)]
    edge = lambda text, at: spark.range(1).select(
        F.lit(at).alias("_part"), *(F.lit(None).cast(rows.schema[f"_k{i}"].dataType).alias(f"_k{i}") for i in range(keys)),
        F.lit(0).cast("long").alias("_piece"), F.lit(text).alias("value"),
    )
    # A comma goes in front of every feature but the first, which is found by its sort keys.
    first = rows.where("_piece = 0").orderBy(*sort).limit(1).select(*[f"_k{i}" for i in range(keys)], F.lit(True).alias("_first"))
    same = [F.col(f"r._k{i}").eqNullSafe(F.col(f"f._k{i}")) for i in range(keys)]
    joined = rows.alias("r").join(F.broadcast(first.alias("f")), same, "left")
    comma = (F.col("r._piece") == 0) & F.col("_first").isNull()
    body = joined.select(
        F.lit(1).alias("_part"), *[F.col(f"r._k{i}").alias(f"_k{i}") for i in range(keys)], F.col("r._piece").alias("_piece"),
        F.when(comma, F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"),
    )
    whole = edge(_OPEN, 0).unionByName(body).unionByName(edge(_CLOSE, 2))
    whole.orderBy("_part", *sort, "_piece").select("value").write.mode("overwrite").text(path)


def collection(df: DataFrame, order: list) -> DataFrame:
    """One row ``collection`` holding the whole document, ``[]`` without features.

    For results known to be small, such as a page of a map; use ``write_collection`` otherwise.
    """
    item = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)], "feature")
    texts = F.transform(F.array_sort(F.collect_list(item)), lambda v: v["feature"])
    return df.agg(
        F.concat(F.lit(_OPEN), F.coalesce(F.array_join(texts, ","), F.lit("")), F.lit(_CLOSE)).alias("collection")
    )
