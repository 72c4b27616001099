"""Selection and normalisation of atom tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chemistry import PEPTIDES


def first_model(atoms: DataFrame) -> DataFrame:
    first = atoms.groupBy("structure_id").agg(F.min("model").alias("model"))
    return atoms.join(first, ["structure_id", "model"])


def standard(atoms: DataFrame) -> DataFrame:
    return atoms.where(F.col("record") == "ATOM")


def chain(atoms: DataFrame, chain_id: str) -> DataFrame:
    return atoms.where(F.col("chain_id") == chain_id)


def file_order(atoms: DataFrame) -> str:
    """The column that orders the atoms of a model: lines of the file, or serials where lines aren't known."""
    return "line" if "line" in atoms.columns else "serial"


def chain_summary(atoms: DataFrame) -> DataFrame:
    """structure_id, chain_id, residues (waters and ligands too; 100 and 100A are two), first (line of the file, or serial where lines aren't known)."""
    icode = F.col("icode") if "icode" in atoms.columns else F.lit(None).cast("string")
    residue = F.struct("record", "res_seq", F.trim(F.coalesce(icode, F.lit(""))).alias("icode"))
    return atoms.groupBy("structure_id", "chain_id").agg(F.count_distinct(residue).alias("residues"), F.min(file_order(atoms)).alias("first"))


def first_two_chains(atoms: DataFrame) -> DataFrame:
    """Targets of structures with two chains or more, in file order."""
    w = Window.partitionBy("structure_id").orderBy("first")
    ranked = chain_summary(atoms).withColumn("k", F.row_number().over(w))
    two = ranked.where("k <= 2").groupBy("structure_id").agg(F.max(F.when(F.col("k") == 1, F.col("chain_id"))).alias("chain_a"), F.max(F.when(F.col("k") == 2, F.col("chain_id"))).alias("chain_b"))
    return two.where("chain_b IS NOT NULL").withColumn("category", F.lit("Auto_Generated"))


def normal_chains(atoms: DataFrame) -> DataFrame:
    """structure_id, chain_id, new_id of structures with exactly two chains: {A,B} stays, H and L become A and B, else the longer becomes A."""
    s = chain_summary(atoms)
    n = s.groupBy("structure_id").agg(F.sort_array(F.collect_set("chain_id")).alias("ids")).where(F.size("ids") == 2)
    longest = F.row_number().over(Window.partitionBy("structure_id").orderBy(F.desc("residues"), "first"))
    known = F.col("ids") == F.array(F.lit("A"), F.lit("B"))
    light = F.col("ids") == F.array(F.lit("H"), F.lit("L"))
    new = F.when(known, F.col("chain_id")).when(light, F.when(F.col("chain_id") == "H", "A").otherwise("B")).otherwise(F.when(longest == 1, "A").otherwise("B"))
    return s.join(n, "structure_id").withColumn("new_id", new).select("structure_id", "chain_id", "new_id", "residues")


def residue_dictionary(atoms: DataFrame) -> DataFrame:
    kind = F.when(F.col("res_name").isin(*PEPTIDES), "L-peptide linking").when(F.col("res_name") == "HOH", "water").otherwise("non-polymer")
    return atoms.select("structure_id", "res_name").distinct().withColumn("kind", kind)


def resolved(atoms: DataFrame) -> DataFrame:
    """One row for each atom name of a residue: the highest occupancy, the first in the file on ties."""
    best = Window.partitionBy("structure_id", "model", "chain_id", "record", "res_seq", "icode", "atom_name").orderBy(F.desc_nulls_last("occupancy"), file_order(atoms))
    return atoms.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


def catalogue(entries: DataFrame, lineage: str = "Homo sapiens", entities: int = 2, limit: int | None = None) -> DataFrame:
    """entry_id of entries(entry_id, lineage array, protein_entities) with that lineage and number of entities; a limit keeps the lowest ids."""
    out = entries.where(F.array_contains("lineage", lineage) & (F.col("protein_entities") == entities)).select("entry_id")
    return out if limit is None else out.orderBy("entry_id").limit(limit)


def rename_conflicts(atoms: DataFrame) -> DataFrame:
    """structure_id of two-chain structures whose shorter chain is called A already, so that the longer one can't take that name first."""
    return normal_chains(atoms).where("chain_id = 'A' and new_id = 'B'").select("structure_id")


def normalized_dimers(atoms: DataFrame, on_conflict: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(atoms, status): standard residues of the first model of two-chain structures, chains called A and B.

    status has structure_id, stage, reason for each structure left out. on_conflict='swap' keeps those
    whose shorter chain is A.
    """
    first = first_model(atoms)
    names = normal_chains(first)
    lost = rename_conflicts(first) if on_conflict == "drop" else names.where("false").select("structure_id")
    names = names.join(lost, "structure_id", "left_anti")
    kept = standard(first).join(names.select("structure_id", "chain_id", "new_id"), ["structure_id", "chain_id"])
    kept = kept.withColumn("chain_id", F.col("new_id")).drop("new_id").select(*atoms.columns)
    other = atoms.select("structure_id").distinct().join(names.select("structure_id"), "structure_id", "left_anti").join(lost, "structure_id", "left_anti")
    reason = lambda df, text: df.select("structure_id", F.lit("normalize").alias("stage"), F.lit(text).alias("reason"))
    return kept, reason(other, "not two chains").unionByName(reason(lost, "name conflict"))


def missing(df: DataFrame, stage: str, reason: Column | str, patch: Column | None = None) -> DataFrame:
    """Rows of a status table for the structures of df."""
    text = F.lit(reason) if isinstance(reason, str) else reason
    return df.select("structure_id", (F.lit(None) if patch is None else patch).cast("int").alias("patch_id"), F.lit(stage).alias("stage"), text.alias("reason"))


def missing_chains(atoms: DataFrame, targets: DataFrame) -> DataFrame:
    """structure_id, stage, reason for targets(structure_id, chain_a, chain_b) that lack their file or a chain."""
    have = atoms.select("structure_id", "chain_id").distinct()
    want = targets.select("structure_id", F.explode(F.array("chain_a", "chain_b")).alias("chain_id")).distinct()
    files = have.select("structure_id").distinct()
    no_file = missing(targets.select("structure_id").distinct().join(files, "structure_id", "left_anti"), "load", "no file")
    lost = want.join(files, "structure_id", "left_semi").join(have, ["structure_id", "chain_id"], "left_anti")
    return no_file.unionByName(missing(lost, "load", F.concat(F.lit("no chain "), "chain_id"))).drop("patch_id")


def resolved_targets(targets: DataFrame, files: DataFrame, extension: str = ".pdb") -> tuple[DataFrame, DataFrame]:
    """(targets, status): targets(structure_id, ..) with the file that they name, of files(name, file), a listing of one folder.

    A target's file is called `<id>.pdb`, or else `<id>` itself (its extension is part of the id); upper and lower case differ.
    Of several listed files of one name the first by path is taken. Targets without a file are in status.
    """
    tries = F.posexplode(F.array(F.concat("structure_id", F.lit(extension)), F.col("structure_id"))).alias("nth", "name")
    ids = targets.where("structure_id is not null").select("structure_id").distinct()
    found = ids.select("structure_id", tries).join(files.groupBy("name").agg(F.min("file").alias("file")), "name")
    best = found.groupBy("structure_id").agg(F.min_by("file", "nth").alias("file"))
    lost = targets.select("structure_id").distinct().join(best, "structure_id", "left_anti")
    return targets.join(best, "structure_id"), missing(lost, "load", "no file")
