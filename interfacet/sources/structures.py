"""Structure files, contact annotations and target lists, read and written as tables.

One file is one structure. Structure files are read by lines, and large ones in blocks that different tasks read: what the
lines before a block decide (their number, models begun, the names of the columns) is added up for each block and carried
on. Lines that don't parse give null fields; empty files give no rows. Contact files are one JSON text each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.structure import file_order, first_model
from .storage import materialize

# Columns of an atom line in PDB format, as name, first column, width, type.
PDB_FIELDS = [("record", 1, 6, "string"), ("serial", 7, 5, "bigint"), ("atom_name", 13, 4, "string"), ("altloc", 17, 1, "string"), ("res_name", 18, 3, "string"), ("chain_id", 22, 1, "string"), ("res_seq", 23, 4, "int"), ("icode", 27, 1, "string"), ("x", 31, 8, "double"), ("y", 39, 8, "double"), ("z", 47, 8, "double"), ("occupancy", 55, 6, "double"), ("element", 77, 2, "string")]
# Columns of the atom loop in mmCIF format, author ids first.
CIF_FIELDS = [("record", ("group_PDB",), "string"), ("serial", ("id",), "bigint"), ("atom_name", ("auth_atom_id", "label_atom_id"), "string"), ("altloc", ("label_alt_id",), "string"), ("res_name", ("auth_comp_id", "label_comp_id"), "string"), ("chain_id", ("auth_asym_id", "label_asym_id"), "string"), ("res_seq", ("auth_seq_id", "label_seq_id"), "int"), ("icode", ("pdbx_PDB_ins_code",), "string"), ("x", ("Cartn_x",), "double"), ("y", ("Cartn_y",), "double"), ("z", ("Cartn_z",), "double"), ("occupancy", ("occupancy",), "double"), ("element", ("type_symbol",), "string"), ("model", ("pdbx_PDB_model_num",), "int")]


def named(raw: DataFrame) -> Column:
    """The structure_id of a file: the partition column if there is one, else the base name."""
    return F.col("structure_id").cast("string") if "structure_id" in raw.columns else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, file, value: whole files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(named(raw).alias("structure_id"), F.col("_metadata.file_path").alias("file"), "value")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, file, block, nth (in its block, from 1), text of every line; a block is what one task reads of a file, at most spark.sql.files.maxPartitionBytes.

    Written, since Spark may cut files otherwise when it reads them again with other filters.
    """
    raw = spark.read.text(path, lineSep="\n")
    rows = raw.select(named(raw).alias("structure_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("read"))
    return materialize(rows.withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("read"))).drop("read"))


def text_lines(whole: DataFrame) -> DataFrame:
    """The same columns from whole(structure_id, value): each text is one block."""
    lines = whole.select("structure_id", F.posexplode(F.split("value", "\n")).alias("nth", "text"))
    return lines.select("structure_id", F.col("structure_id").alias("file"), F.lit(0).cast("long").alias("block"), (F.col("nth") + 1).alias("nth"), "text")


def carried(lines: DataFrame, **counts: Column) -> DataFrame:
    """lines with line (in the file, from 0), and for each of counts how many lines of the file hold it, up to this one.

    Blocks are counted on their own; what went before a block comes from the table of blocks, which has one row for each.
    """
    ones = {"line": F.lit(True), **counts}
    size = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    blocks = lines.groupBy("file", "block").agg(*[size(c).alias(f"_{k}") for k, c in ones.items()])
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in ones])
    here = Window.partitionBy("file", "block").orderBy("nth")
    out = lines.withColumns({k: size(c).over(here) for k, c in counts.items()}).join(blocks, ["file", "block"])
    return out.withColumns({"line": (F.col("_line") + F.col("nth") - 1).cast("int"), **{k: F.col(k) + F.col(f"_{k}") for k in counts}}).drop(*[f"_{k}" for k in ones])


def pdb_atoms(lines: DataFrame) -> DataFrame:
    """structure_id, model, line and the PDB fields of every atom line; models count from 1 in file order."""
    found = carried(lines, models=F.col("text").startswith("MODEL ")).where(F.col("text").rlike("^(ATOM  |HETATM)"))
    fields = [F.trim(F.substring("text", at, width)).try_cast(kind).alias(name) for name, at, width, kind in PDB_FIELDS]
    return found.select("structure_id", F.greatest("models", F.lit(1)).cast("int").alias("model"), "line", *fields)


def cif_atoms(lines: DataFrame) -> DataFrame:
    """The same columns from the atom loop of mmCIF files; `.` and `?` are null, quoted values lose their quotes."""
    lines = carried(lines)
    head = lines.where(F.col("text").startswith("_atom_site."))
    column = F.struct("line", F.substring_index(F.trim("text"), ".", -1).alias("name"))
    names = head.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(column)), lambda c: c["name"]).alias("names"))  # a few dozen columns
    tokens = F.regexp_extract_all("text", F.lit(r"""('[^']*'|"[^"]*"|\S+)"""), F.lit(1))
    row = lines.where(F.col("text").rlike(r"^(ATOM|HETATM)\s")).join(names, "file").withColumn("tokens", tokens)
    row = row.where(F.size("tokens") == F.size("names")).withColumn("row", F.map_from_arrays("names", "tokens"))

    def value(options: tuple[str, ...]) -> Column:
        found = [F.col("row")[o] for o in options]
        return F.coalesce(*[F.when(~v.isin(".", "?"), F.regexp_replace(v, r"""^(['"])(.*)\1$""", "$2")) for v in found])

    return row.select("structure_id", "line", *[value(options).try_cast(kind).alias(name) for name, options, kind in CIF_FIELDS])


def parse_pdb(whole: DataFrame) -> DataFrame:
    """`pdb_atoms` of whole texts."""
    return pdb_atoms(text_lines(whole))


def parse_mmcif(whole: DataFrame) -> DataFrame:
    """`cif_atoms` of whole texts."""
    return cif_atoms(text_lines(whole))


def read_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of every file below path: mmCIF where the name ends in .cif, PDB otherwise."""
    lines = file_lines(spark, path)
    cif = F.col("file").endswith(".cif")
    return pdb_atoms(lines.where(~cif)).unionByName(cif_atoms(lines.where(cif)))


def pdb_lines(atoms: DataFrame) -> DataFrame:
    """structure_id, at (place in the file), value: an 80-column line for each atom; serials start anew after 99,999."""
    name = F.when(F.length("atom_name") < 4, F.concat(F.lit(" "), F.col("atom_name"))).otherwise(F.col("atom_name"))
    icode = F.coalesce(F.rpad(F.col("icode"), 1, " "), F.lit(" ")) if "icode" in atoms.columns else F.lit(" ")
    line = F.format_string("%-6s%5d %-4s %3s %1s%4d%1s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s  ", "record", F.col("serial") % 100000, name, "res_name", "chain_id", "res_seq", icode, "x", "y", "z", F.lit(1.0), F.lit(0.0), "element")
    return atoms.select("structure_id", F.col(file_order(atoms)).alias("at"), line.alias("value"))


def write_pdb_text(atoms: DataFrame, root: str) -> None:
    """One PDB file for each structure, below structure_id=<id>: its first model, in the order of its lines."""
    lines = pdb_lines(first_model(atoms)).repartition("structure_id").sortWithinPartitions("structure_id", "at")
    lines.select("structure_id", "value").write.partitionBy("structure_id").text(root)


def parse_contacts(whole: DataFrame) -> DataFrame:
    """structure_id, contact (its number in the text), bgn_chain, bgn_seq, end_chain, end_seq, raw_type: a row for each contact and type.

    The text is an array of contacts or an object with one under `interactions`; type is a string or an
    array of strings; a missing end is null; what isn't JSON gives no rows.
    """
    end = "struct<auth_asym_id:string,auth_seq_id:string>"
    item = f"struct<bgn:{end},end:{end},type:string>"
    listed = F.ltrim("value").startswith("[")
    items = F.when(listed, F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"struct<interactions:array<{item}>>")["interactions"])
    one = whole.select("structure_id", F.posexplode(items).alias("contact", "c"))
    types = F.when(F.ltrim("c.type").startswith("["), F.from_json("c.type", "array<string>")).otherwise(F.array("c.type"))
    cols = [F.col(f"c.{e}.auth_{k}_id").alias(f"{e}_{n}") for e in ("bgn", "end") for k, n in (("asym", "chain"), ("seq", "seq"))]
    return one.select("structure_id", "contact", *cols, F.explode(types).alias("raw_type"))


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    return parse_contacts(texts(spark, path))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """PDB, Chain_A, Chain_B, Category (Uncategorized where it is missing) of a CSV file with a header."""
    raw = spark.read.csv(path, header=True)
    category = F.col("Category") if "Category" in raw.columns else F.lit(None).cast("string")
    return raw.select("PDB", "Chain_A", "Chain_B", F.coalesce(category, F.lit("Uncategorized")).alias("Category"))


def list_structures(spark: SparkSession, path: str) -> DataFrame:
    """structure_id, file of every .pdb file of a folder, whatever its case; Spark leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][bB]").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("structure_id"), F.col("path").alias("file"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """name, file of everything in a folder; Spark leaves out files of no bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("path").alias("file"))


def write_by(df: DataFrame, root: str, *keys: str) -> None:
    """CSV files with a header below a folder for each value of keys; no rows, no files."""
    df.repartition(*keys).write.partitionBy(*keys).option("header", True).csv(root)


def write_distortion(df: DataFrame, root: str) -> None:
    write_by(df, root, "category", "structure_id")


def write_sweep(df: DataFrame, root: str) -> None:
    write_by(df, root, "param", "structure_id")


def write_in_order(df: DataFrame, root: str, *keys: str) -> None:
    """CSV files with a header, by ranges of keys: in the order of the files' names, rows are in order of keys. Nulls come first."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("header", True).csv(root)


def write_dictionary(df: DataFrame, root: str) -> None:
    """`structure.residue_dictionary` in order of names, structure by structure."""
    write_in_order(df, root, "structure_id", "res_name")
