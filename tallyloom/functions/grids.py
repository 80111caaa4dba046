"""Grids as array<array<int>> columns: parsing, transforms, rendering. No Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import bind

# Fixed pattern of a rendered grid block: (HxW): and H lines of digits.
BLOCK = r"\((\d+)x(\d+)\):\n((?:\d(?: \d)*\n)+)"
HEADED = r"(?m)^(Input|Output) \((\d+)x(\d+)\):\n((?:\d+(?: \d+)*(?:\n|\z)|\n)*)"

# Fixed geometry names: quarter turns counter-clockwise, or a flip axis.
GEOMETRIES = ("rot90", "rot180", "rot270", "fliph", "flipv")
INVERSE = {"rot90": "rot270", "rot180": "rot180", "rot270": "rot90", "fliph": "fliph", "flipv": "flipv"}
ROT_TURNS = {"rot90": 1, "rot180": 2, "rot270": 3}
FLIP_AXIS = {"fliph": 1, "flipv": 0}
BASE_NAME = "_transform_base"

GRID = "array<array<int>>"


def to_grid(body: Column) -> Column:
    """Digit lines to rows; blank lines are skipped."""
    lines = F.filter(F.split(body, "\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.split(x, " ").cast("array<int>"))


def _shaped(grid: Column, height: Column, width: Column) -> Column:
    return (F.size(grid) == height) & F.forall(grid, lambda r: F.size(r) == width)


def parse_grids(prompt: Column) -> Column:
    """array<struct<grid, ok>> of every block in order; ok says the declared shape holds."""
    part = lambda i: F.regexp_extract_all(prompt, F.lit(BLOCK), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("h"), part(2).alias("w"), part(3).alias("b"))
    return F.transform(
        zipped,
        lambda z: F.struct(
            to_grid(z["b"]).alias("grid"),
            _shaped(to_grid(z["b"]), z["h"].cast("int"), z["w"].cast("int")).alias("ok"),
        ),
    )


def parse_headed(prompt: Column) -> Column:
    """array<struct<key, grid, ok>> under Input/Output headers; cells may have several digits."""
    part = lambda i: F.regexp_extract_all(prompt, F.lit(HEADED), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("k"), part(2).alias("h"), part(3).alias("w"), part(4).alias("b"))
    return F.transform(
        zipped,
        lambda z: F.struct(
            F.lower(z["k"]).alias("key"), to_grid(z["b"]).alias("grid"),
            _shaped(to_grid(z["b"]), z["h"].cast("int"), z["w"].cast("int")).alias("ok"),
        ),
    )


def pair_up(grids: Column) -> Column:
    """Consecutive (input, output) structs; null when the count is odd."""
    def paired(g: Column) -> Column:
        steps = F.when(F.size(g) > 0, F.sequence(F.lit(0), F.size(g) - 2, F.lit(2))).otherwise(
            F.array().cast("array<int>"))
        return F.when(
            F.size(g) % 2 == 0,
            F.transform(steps, lambda i: F.struct(F.get(g, i).alias("input"), F.get(g, i + 1).alias("output"))),
        )

    return bind(grids, paired)


def bad_prompt(parsed: Column) -> Column:
    """Why a parsed prompt cannot be scored, or null."""
    return (
        F.when(~F.forall(parsed, lambda p: p["ok"]), "declared shape differs")
        .when(F.size(parsed) % 2 != 0, "odd number of grids")
    )


def transpose(grid: Column) -> Column:
    columns = F.when(F.size(grid) > 0, F.sequence(F.lit(0), F.size(F.get(grid, F.lit(0))) - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(columns, lambda j: F.transform(grid, lambda row: F.get(row, j)))


def apply_geometry(grid: Column, geometry: Column) -> Column:
    mirrored = lambda g: F.transform(g, lambda row: F.reverse(row))
    return bind(
        grid,
        lambda g: F.when(geometry == "rot90", F.reverse(transpose(g)))
        .when(geometry == "rot180", F.reverse(mirrored(g)))
        .when(geometry == "rot270", mirrored(transpose(g)))
        .when(geometry == "fliph", mirrored(g))
        .when(geometry == "flipv", F.reverse(g))
        .otherwise(g),
    )


def apply_colours(grid: Column, perm: Column) -> Column:
    """Look every cell up in the permutation; a null permutation changes nothing."""
    return F.when(perm.isNull(), grid).otherwise(
        F.transform(grid, lambda row: F.transform(row, lambda c: F.get(perm, c)))
    )


def transform_grid(grid: Column, geometry: Column, perm: Column) -> Column:
    """Geometry first, colours second."""
    return apply_colours(apply_geometry(grid, geometry), perm)


def transform_pairs(pairs: Column, geometry: Column, perm: Column) -> Column:
    return F.transform(
        pairs,
        lambda p: F.struct(
            transform_grid(p["input"], geometry, perm).alias("input"),
            transform_grid(p["output"], geometry, perm).alias("output"),
        ),
    )


def invert_permutation(perm: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(perm) - 1), lambda i: (F.array_position(perm, i) - 1).cast("int")
    )


def render_grid(grid: Column) -> Column:
    lines = F.transform(grid, lambda row: F.array_join(row.cast("array<string>"), " "))
    shape = F.concat(
        F.lit("("), F.size(grid).cast("string"), F.lit("x"),
        F.size(F.get(grid, F.lit(0))).cast("string"), F.lit("):\n"),
    )
    return F.concat(shape, F.array_join(lines, "\n"), F.lit("\n"))


def rerender(prompt: Column, grids: Column) -> Column:
    """The prompt with its i-th block replaced by the i-th grid, every other character kept.

    Null when the block count differs from the grid count.
    """
    gaps = F.split(prompt, BLOCK, -1)
    blocks = F.transform(grids, render_grid)
    return F.when(
        F.size(gaps) == F.size(grids) + 1,
        F.array_join(
            F.zip_with(gaps, blocks, lambda gap, block: F.concat(gap, F.coalesce(block, F.lit("")))), ""
        ),
    )


def _literal(perm: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(perm.cast("array<string>"), ", "), F.lit("]"))


def wrap_code(code: Column, geometry: Column, perm: Column) -> Column:
    """Source text that undoes a transform, calls the renamed base program and redoes it."""
    base = F.regexp_replace(F.regexp_replace(code, r"\btransform\b", BASE_NAME), r"\s+$", "")

    def moved(var: str, source: str, undo: bool) -> Column:
        step = F.lit(None).cast("string")
        for name, turns in ROT_TURNS.items():
            step = F.when(geometry == name, f"    {var} = np.rot90({source}, {4 - turns if undo else turns})").otherwise(step)
        for name, axis in FLIP_AXIS.items():
            step = F.when(geometry == name, f"    {var} = np.flip({source}, {axis})").otherwise(step)
        return step

    coloured = lambda text: F.when(perm.isNotNull(), text)
    lines = F.array(
        base, F.lit(""), F.lit(""), F.lit("def transform(grid):"), F.lit("    import numpy as np"),
        coloured(F.concat(F.lit("    _perm = np.array("), _literal(perm), F.lit(")"))),
        coloured(F.concat(F.lit("    _inv_perm = np.array("), _literal(invert_permutation(perm)), F.lit(")"))),
        F.lit("    g = np.array(grid)"),
        coloured(F.lit("    g = _inv_perm[g]")),
        moved("g", "g", True),
        F.lit(f"    out = np.array({BASE_NAME}(g.tolist()))"),
        moved("out", "out", False),
        coloured(F.lit("    out = _perm[out]")),
        F.lit("    return out.tolist()"),
    )
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")
