"""Interaction types of residues, from distances or from annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chemistry import atom_kind, canonical, pair_type, rank, sequence_number
from .spatial import near_pairs

ATTRIBUTES = ("res_name", "atom_name", "element")


def typed_pairs(a: DataFrame, b: DataFrame, radius: float = 6.0) -> DataFrame:
    """Atom pairs of two chains of a structure within `radius`, with d and type."""
    kind = atom_kind(*map(F.col, ATTRIBUTES))
    left = a.select("structure_id", "serial", "res_seq", "x", "y", "z", kind.alias("a_kind"))
    right = b.select("structure_id", F.col("serial").alias("b_serial"), *[F.col(k).alias(f"b{k}") for k in "xyz"], kind.alias("b_kind"))
    return near_pairs(left, right, ["structure_id"], radius).withColumn("type", pair_type(F.col("d"), F.col("a_kind"), F.col("b_kind")))


def best_types(pairs: DataFrame) -> DataFrame:
    """structure_id, res_seq, type: the type of lowest rank for each residue."""
    return pairs.where("type IS NOT NULL").groupBy("structure_id", "res_seq").agg(F.min_by("type", rank(F.col("type"))).alias("type"))


def name(chain: str | Column) -> Column:
    return F.lit(chain) if isinstance(chain, str) else chain


def annotated_types(contacts: DataFrame, a: str | Column = "A", b: str | Column = "B") -> DataFrame:
    """structure_id, res_seq, types of residues of chain a from annotations between chains a and b, names or columns."""
    a, b = name(a), name(b)
    ends = F.array_sort(F.array_distinct(F.array(F.trim("bgn_chain"), F.trim("end_chain"))))
    wanted = F.array_sort(F.array_distinct(F.array(a, b)))
    seq = F.when(F.trim("bgn_chain") == a, F.col("bgn_seq")).otherwise(F.col("end_seq"))
    number = sequence_number(seq)
    rows = contacts.where(ends == wanted).select("structure_id", number.alias("res_seq"), canonical(F.col("raw_type")).alias("type"))
    return rows.where("type IS NOT NULL AND res_seq IS NOT NULL").groupBy("structure_id", "res_seq").agg(F.sort_array(F.collect_set("type")).alias("types"))


def diagnostics(contacts: DataFrame, a: str | Column = "A", b: str | Column = "B") -> DataFrame:
    """structure_id, chain_pairs, raw_types (sorted), mapped: what annotations hold; where mapped is 0, use distances.

    Pairs of named chains are listed whatever they are; raw types and mapped only look at contacts between
    chains a and b whose residue of chain a has a readable number. mapped counts contacts with any known
    type: rows that share `contact`, or all rows where there is no such column.
    """
    bgn, end, a, b = F.trim("bgn_chain"), F.trim("end_chain"), name(a), name(b)
    pair = F.when((bgn != "") & (end != ""), F.concat_ws("-", F.array_sort(F.array(bgn, end))))
    wanted = F.array_sort(F.array_distinct(F.array(bgn, end))) == F.array_sort(F.array_distinct(F.array(a, b)))
    number = sequence_number(F.when(bgn == a, F.col("bgn_seq")).otherwise(F.col("end_seq")))
    used = F.coalesce(wanted & number.isNotNull(), F.lit(False))
    known = used & canonical(F.col("raw_type")).isNotNull()
    mapped = F.count_distinct(F.when(known, F.col("contact"))) if "contact" in contacts.columns else F.sum(known.cast("long"))
    return contacts.groupBy("structure_id").agg(F.sort_array(F.collect_set(pair)).alias("chain_pairs"), F.sort_array(F.collect_set(F.when(used, F.col("raw_type")))).alias("raw_types"), mapped.alias("mapped"))
