"""Column expressions over atom pairs and annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interaction types in order of rank, and the annotators' names for them.
INTERACTIONS = ["default", "salt_bridge", "cation_pi", "pi_stack", "hbond", "sulfur_pi", "hydrophobic", "halogen_bond", "metal_complex"]
RAW_TYPES = {
    "salt_bridge": ["salt_bridge", "ionic"], "cation_pi": ["cation_pi", "pi_cation"], "pi_stack": ["pi_stack", "pi_pi", "amide_ring"],
    "hbond": ["hbond", "weak_hbond", "polar", "weak_polar"], "halogen_bond": ["xbond", "halogen_bond"], "sulfur_pi": ["sulfur_pi", "pi_sulfur"],
    "hydrophobic": ["hydrophobic", "aromatic"], "metal_complex": ["metal_complex", "covalent"], "default": ["vdw", "vdw_clash", "clash", "proximal", "atom-atom"],
}
# The colour of each interaction type.
COLORS = {
    "default": "#008080", "salt_bridge": "#FFA500", "cation_pi": "#FF4500", "pi_stack": "#8A2BE2", "hbond": "#0000FF",
    "sulfur_pi": "#FFD700", "hydrophobic": "#808080", "halogen_bond": "#00CED1", "metal_complex": "#A52A2A",
}
# Residues of peptide chains.
PEPTIDES = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL UNK".split()


KINDS = ("cation", "anion", "ring", "polar", "sulfur", "carbon", "plain")  # a bit each in `atom_kind`


def atom_kind(res: Column, atom: Column, el: Column) -> Column:
    """What the rules of `pair_type` ask of an atom, as bits, so that texts are compared once an atom and not once a pair; what isn't known does not hold."""
    ring = res.isin("PHE", "TYR", "TRP", "HIS") & ~atom.isin("CA", "C", "O", "N")
    holds = {
        "cation": res.isin("ARG", "LYS", "HIS") & atom.isin("NZ", "NH1", "NH2", "ND1", "NE2"),
        "anion": (res.isin("ASP", "GLU") & atom.isin("OD1", "OD2", "OE1", "OE2")) | (atom == "OXT"),
        "ring": ring, "polar": el.isin("N", "O", "S", "F"), "sulfur": atom.isin("SG", "SD"), "carbon": el == "C",
        "plain": (el == "C") & ~atom.isin("CA", "C") & ~ring,
    }
    return sum((F.when(holds[k], 1 << i).otherwise(0) for i, k in enumerate(KINDS)), F.lit(0))


def pair_type(d: Column, a: Column, b: Column) -> Column:
    """Interaction of two atoms at distance d by the first rule that holds, null if none; a and b are each one's `atom_kind`."""
    x, y = ({k: c.bitwiseAND(F.lit(1 << i)) != 0 for i, k in enumerate(KINDS)} for c in (a, b))
    both = lambda p, q: (x[p] & y[q]) | (x[q] & y[p])
    greasy = both("ring", "plain") | (x["plain"] & y["plain"])
    return (
        F.when(d > 6, None).when((d < 4) & both("cation", "anion"), "salt_bridge").when((d < 5) & both("ring", "cation"), "cation_pi")
        .when((d < 5) & both("cation", "anion"), "salt_bridge").when((d < 3.8) & ((x["polar"] & y["polar"]) | both("carbon", "polar")), "hbond")
        .when((d < 4.5) & both("ring", "sulfur"), "sulfur_pi").when((d < 5.5) & x["ring"] & y["ring"], "pi_stack").when((d < 4.5) & greasy, "hydrophobic")
    )


def canonical(raw: Column) -> Column:
    """Interaction type of an annotator's name, null for unknown ones."""
    out = F.lit(None).cast("string")
    for name, raws in RAW_TYPES.items():
        out = F.when(raw.isin(*raws), name).otherwise(out)
    return out


def rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, INTERACTIONS)), kind)


def sequence_number(text: Column) -> Column:
    """The leading integer of a residue number such as 100A, null if there is none."""
    return F.regexp_extract(text, r"^\s*(-?\d+)", 1).try_cast("int")
