"""Identifiers, class codes, seeds and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shapes and colours in index order, and the bits of colours.
SHAPES = ("circle", "star", "triangle", "square", "pentagon", "hexagon")
COLOURS = ("red", "green", "blue", "yellow", "magenta", "cyan")
COLOUR_BITS = (0b100, 0b010, 0b001, 0b110, 0b101, 0b011)
SEED_OFFSETS = {"scene_layout": 0, "trajectory": 1_000_000, "text_grammar": 2_000_000, "lexical_noise": 3_000_000}
SEED_SPACE = 65_536
#: The multipliers of splitmix64.
GOLDEN, MIX_1, MIX_2 = 0x9E37_79B9_7F4A_7C15, 0xBF58_476D_1CE4_E5B9, 0x94D0_49BB_1331_11EB
QUERY_SALT = 0xD1B5_4A32_D192_ED03
_TWO_64 = 1 << 64


def scene_id(index: Column) -> Column:
    """32 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(index)), 32, "0")


def seeds(master: Column, index: Column) -> dict[str, Column]:
    """The seeds of a scene's four streams; an overflow is an error."""
    return {f"seed_{name}": (master + index + F.lit(offset)).cast("bigint") for name, offset in SEED_OFFSETS.items()}


def effective_index(seed: Column, index: Column) -> Column:
    """The index of a scene for a seed beyond the seed space: what exceeds the space moves the index."""
    return (F.floor(seed / SEED_SPACE) * SEED_SPACE + index).cast("bigint")


def class_code(shape: Column, colour: Column) -> Column:
    """The code of a shape type and a colour, both by index."""
    bits = F.get(F.array(*map(F.lit, COLOUR_BITS)), colour)
    return F.shiftleft(shape + 1, 3).bitwiseOR(bits)


def fixed_identity(index: Column) -> Column:
    """The identity (shape_type, color, shape_id) that an index has where none are drawn: types in order, colours in turn; null beyond the types."""
    shape, colour = F.get(F.array(*map(F.lit, SHAPES)), index.cast("int")), F.get(F.array(*map(F.lit, COLOURS)), (index % len(COLOURS)).cast("int"))
    return F.when(shape.isNotNull(), F.struct(shape.alias("shape_type"), colour.alias("color"), F.concat_ws("_", shape, colour).alias("shape_id")))


def classes(spark: SparkSession) -> DataFrame:
    """The 36 classes: shape and colour (index and name), shape_id, code, and rank, the number of smaller codes."""
    rows = [(i, j, s, c, f"{s}_{c}") for i, s in enumerate(SHAPES) for j, c in enumerate(COLOURS)]
    out = spark.createDataFrame(rows, "shape_index int, color_index int, shape_type string, color string, shape_id string")
    out = out.withColumn("code", class_code(F.col("shape_index"), F.col("color_index")))
    return out.withColumn("class_rank", (F.rank().over(Window.partitionBy(F.lit(0)).orderBy("code")) - 1).cast("int"))


def _signed(x: Column) -> Column:
    """A whole number from 0 to 2^64, as a decimal, as the bigint with the same bits."""
    return F.when(x >= F.lit(str(1 << 63)).cast("decimal(38,0)"), x - F.lit(str(_TWO_64)).cast("decimal(38,0)")).otherwise(x).cast("bigint")


def _unsigned(x: Column) -> Column:
    wide = x.cast("decimal(38,0)")
    return F.when(x < 0, wide + F.lit(str(_TWO_64)).cast("decimal(38,0)")).otherwise(wide)


def wrapping_add(x: Column, k: int) -> Column:
    """x + k modulo 2^64, without an overflow error in any mode."""
    return _signed(F.pmod(_unsigned(x) + F.lit(str(k)).cast("decimal(38,0)"), F.lit(str(_TWO_64)).cast("decimal(38,0)")))


def wrapping_mul(x: Column, k: int) -> Column:
    """x * k modulo 2^64: by halves of 32 bits, whose products fit into decimals."""
    two_32 = F.lit(1 << 32).cast("decimal(38,0)")
    low = x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(20,0)")
    high = F.shiftrightunsigned(x, 32).cast("decimal(20,0)")
    factor = F.lit(str(k)).cast("decimal(20,0)")
    a = F.pmod((low * factor).cast("decimal(38,0)"), F.lit(str(_TWO_64)).cast("decimal(38,0)"))
    b = F.pmod((high * factor).cast("decimal(38,0)"), two_32)
    return _signed(F.pmod((a + b * two_32).cast("decimal(38,0)"), F.lit(str(_TWO_64)).cast("decimal(38,0)")))


def splitmix64(x: Column) -> Column:
    """The splitmix64 hash of a bigint, as a bigint of the same bits."""

    def step(v: Column, shift: int) -> Column:
        return v.bitwiseXOR(F.shiftrightunsigned(v, shift))

    bound = lambda v, f: F.transform(F.array(v), f)[0]
    return bound(wrapping_add(x, GOLDEN), lambda a: bound(wrapping_mul(step(a, 30), MIX_1), lambda b: bound(wrapping_mul(step(b, 27), MIX_2), lambda c: step(c, 31))))


def unsigned_mod(x: Column, n: Column) -> Column:
    return F.pmod(_unsigned(x), n.cast("decimal(38,0)")).cast("bigint")


def query_index(seed: Column, entity: Column, n: Column) -> Column:
    """Which of an entity's n events is asked about: from 0, spread evenly by a hash of seed and entity."""
    salt = QUERY_SALT - _TWO_64
    return unsigned_mod(splitmix64(seed.cast("bigint").bitwiseXOR(wrapping_mul(entity.cast("bigint"), GOLDEN)).bitwiseXOR(F.lit(salt))), n)
