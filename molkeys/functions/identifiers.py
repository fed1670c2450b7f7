"""Identifiers, labels and lists of the sample tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that may end an identifier.
LABELS = ("CI", "NCI", "WCI", "I", "NI")
# One-letter codes of ligand chains.
LIGAND_LETTERS = {"NAG": "N", "MAN": "M", "BMA": "B", "FUC": "F", "BGC": "G", "GAL": "A", "FUL": "U", "NDG": "D"}


def clean(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def upper(c: Column) -> Column:
    return F.upper(clean(c))


def seqnum(c: Column) -> Column:
    """``58.0`` to ``58``; insertion codes such as ``476A`` stay."""
    return F.regexp_replace(clean(c), "^(-?\\d+)\\.0+$", "$1")


def split_list(c: Column, separators: str = "[;,]") -> Column:
    """Distinct non-empty parts in first-seen order."""
    return F.array_distinct(F.filter(F.transform(F.split(clean(c), separators), lambda x: seqnum(x)), lambda x: x != ""))


def pdb_id(c: Column) -> Column:
    """First word without quotes, upper-cased."""
    return F.upper(F.regexp_extract(F.regexp_replace(clean(c), "[\"']", ""), "^\\s*(\\S+)", 1))


def list_id(c: Column) -> Column:
    """The id that a line of an id list begins with: without quotes, its first word, cut at a dot and at a dash behind four places or more.

    Upper-cased; null where other characters than letters, digits and underscores are left.
    """
    word = F.regexp_extract(F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), '^"+|"+$', ""), "^'+|'+$", ""), "^\\s*(\\S+)", 1)
    word = F.substring_index(word, ".", 1)
    head = F.substring_index(word, "-", 1)
    word = F.when(word.contains("-") & (F.char_length(head) >= 4), head).otherwise(word)
    return F.when(word.rlike("^[A-Za-z0-9_]+$"), F.upper(word))


def is_pdb_id(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9]{4}$")


def is_seqnum(c: Column) -> Column:
    return c.rlike("^-?\\d+[A-Za-z]?$")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used: as the variable of a function over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _tokens(c: Column) -> Column:
    """(t, label): the filled parts of an identifier without its label, and the label: one of four or more parts may be."""

    def parts(whole: Column) -> Column:
        last = F.upper(F.element_at(whole, -1))
        labelled = (F.size(whole) >= 4) & last.isin(*LABELS)
        return F.struct(F.when(labelled, F.slice(whole, F.lit(1), F.size(whole) - 1)).otherwise(whole).alias("t"), F.when(labelled, last).otherwise("").alias("label"))

    return bound(F.filter(F.transform(F.split(clean(c), "_"), lambda x: F.trim(x)), lambda x: x != ""), parts)


def without_label(c: Column) -> Column:
    return F.array_join(_tokens(c)["t"], "_")


def parse_identifier(c: Column) -> Column:
    """(kind, pdb, chain, seq, res, grp, label) of ``PDB_CHAIN_SEQ_RES``, ``SEQ_PDB_CHAIN_RES``, ``PDB_CHAIN_GROUP`` or ``PDB_CHAIN``; else RAW.

    Both orders of four parts give the first kind; parts beyond the fourth are ignored. Chains keep their case.
    """
    return bound(_tokens(c), lambda parts: _parsed(parts["t"], parts["label"]))


def _parsed(t: Column, label: Column) -> Column:
    n = F.size(t)
    at = lambda i: F.get(t, F.lit(i))
    none = F.lit(None).cast("string")
    made = lambda kind, pdb, chain, seq, res, grp: F.struct(F.lit(kind).alias("kind"), pdb.alias("pdb"), chain.alias("chain"), seq.alias("seq"), res.alias("res"), grp.alias("grp"), label.alias("label"))
    return (
        F.when((n >= 4) & is_pdb_id(at(0)) & is_seqnum(at(2)), made("PDB_CHAIN_SEQ_RESIDUE", F.upper(at(0)), at(1), at(2), F.upper(at(3)), none))
        .when((n >= 4) & is_seqnum(at(0)) & is_pdb_id(at(1)), made("PDB_CHAIN_SEQ_RESIDUE", F.upper(at(1)), at(2), at(0), F.upper(at(3)), none))
        .when((n == 3) & is_pdb_id(at(0)) & ~is_seqnum(at(2)), made("PDB_CHAIN_GROUP", F.upper(at(0)), at(1), none, none, F.upper(at(2))))
        .when((n == 2) & is_pdb_id(at(0)), made("PDB_CHAIN", F.upper(at(0)), at(1), none, none, none))
        .otherwise(made("RAW", none, none, none, none, none))
    )


def canonical(parsed: Column, raw: Column) -> Column:
    parts = lambda p: F.array_join(F.array_compact(F.array(p["pdb"], p["chain"], p["seq"], p["res"], p["grp"])), "_")
    return bound(parsed, lambda p: F.when(p["kind"] == "RAW", clean(raw)).otherwise(parts(p)))


def with_label(identifier: Column, label: Column) -> Column:
    return F.concat_ws("_", identifier, F.when(clean(label) != "", clean(label)))


def last_token(c: Column) -> Column:
    return F.element_at(F.split(c, "_"), -1)


def token(c: Column, place: int) -> Column:
    """One part of an identifier, from 0; the third is its number where a file calls it a type. Null where there are fewer."""
    return F.get(F.split(c, "_"), F.lit(place))


def chain_group(name: Column) -> Column:
    """The group at the end of a key file's name before ``.keys``, upper-cased; null with fewer than three parts."""
    parts = F.split(F.substring_index(name, ".keys", 1), "_")
    return F.when(F.size(parts) >= 3, F.upper(F.element_at(parts, -1)))


def file_residue(name: Column) -> Column:
    """The residue at the end of a key file's name before ``.keys``, as written."""
    return F.element_at(F.split(F.substring_index(F.substring_index(name, "/", -1), ".keys", 1), "_"), -1)


def in_groups(group: Column, groups: list[str], rule: str = "exact") -> Column:
    """Whether a chain group is one of the groups, or (rule ``contains``) holds one of them; case does not count."""
    wanted = sorted({g.strip().upper() for g in groups if g.strip()})
    if not wanted or rule not in ("exact", "contains"):
        raise ValueError("groups are needed, and the rule exact or contains")
    hit = group.isin(*wanted) if rule == "exact" else F.exists(F.array(*[F.lit(g) for g in wanted]), lambda g: group.contains(g))
    return F.coalesce(hit, F.lit(False))


def split_group(c: Column, parts: int) -> Column:
    """First one (PDB) or two (PDB and chain) tokens."""
    return F.substring_index(c, "_", parts)


def right_split(c: Column) -> Column:
    """(protein, chain, seq, res) cut from the right, so that the protein may hold underscores."""
    pattern = "^(.*)_([^_]*)_([^_]*)_([^_]*)$"
    return F.struct(*[F.regexp_extract(c, pattern, i).alias(k) for i, k in enumerate(("protein", "chain", "seq", "res"), 1)])


def atom_id_parts(c: Column) -> Column:
    """(pdb, chain, res, resnum, atom) of a contact table's atom identifier, cut from the right."""
    pattern = "^(.*)_([^_]*)_([^_]*)_([^_]*)_([^_]*)$"
    return F.struct(*[F.regexp_extract(c, pattern, i).alias(k) for i, k in enumerate(("pdb", "chain", "res", "resnum", "atom"), 1)])


def ligand_code(names: Column) -> Column:
    """Letters of a list of ligand names; an unknown name is an error."""
    letters = F.create_map(*[F.lit(x) for kv in LIGAND_LETTERS.items() for x in kv])
    one = lambda x: F.coalesce(F.try_element_at(letters, F.upper(x)), F.raise_error(F.concat(F.lit("unknown ligand "), x)))
    return F.array_join(F.transform(F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != ""), one), "")


def natural_key(c: Column) -> Column:
    """Sort key of sequence numbers: integers by value, then all others as text."""
    number = c.try_cast("long")
    return F.struct(F.when(number.isNotNull(), 0).otherwise(1).alias("kind"), F.coalesce(number, F.lit(0)).alias("number"), c.alias("text"))


def insertion_key(c: Column) -> Column:
    """Sort key by number and insertion code; what is neither comes last."""
    number, code = F.regexp_extract(c, "^(-?\\d+)([A-Za-z]?)$", 1), F.regexp_extract(c, "^(-?\\d+)([A-Za-z]?)$", 2)
    return F.struct(F.when(number != "", 0).otherwise(1).alias("kind"), F.coalesce(number.try_cast("long"), F.lit(0)).alias("number"), F.when(number != "", code).otherwise(c).alias("text"))


def sorted_join(values: Column, key=natural_key, separator: str = ";") -> Column:
    """Distinct values in natural order, joined."""
    keyed = F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct(key(v).alias("k"), v.alias("v"))))
    return F.array_join(F.transform(keyed, lambda x: x["v"]), separator)


def similarity(d: Column) -> Column:
    """100 - 100 d of a decimal distance, as text without trailing zeros."""
    s = (F.lit(100).cast("decimal(20,10)") - d.cast("decimal(20,10)") * F.lit(100).cast("decimal(3,0)")).cast("decimal(20,10)").cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "\\.$", "")).otherwise(s)


def interaction_label(d: Column, ci: float = 1.5, wci: float = 2.0) -> Column:
    return F.when(d <= ci, "ci").when(d <= wci, "wci").otherwise("nci")


def chain_order(chain: Column) -> Column:
    """Order of chains: by name, blank ones last."""
    blank = F.coalesce(F.trim(chain), F.lit("")) == ""
    return F.struct(blank.alias("blank"), F.coalesce(F.trim(chain), F.lit("")).alias("chain"))


def half_even(value: Column, digits: int) -> Column:
    """Text of so many decimals of a double's exact binary value, halves to the even digit, as C and Python print it.

    The fraction times a power of ten is taken as a product and its exact rounding error, so nothing is lost. The sign stays, also of a zero. Exact up
    to 2^115; larger values, null and what is not finite are null.
    """
    x = value.cast("double")
    size = F.abs(x)
    whole = F.floor(F.when(size < 2.0**63, size).otherwise(0.0)).cast("double")
    part = F.when(size < 2.0**53, size - whole).otherwise(0.0)
    power = 10.0**digits
    # both factors in halves of 26 bits, whose products are exact
    split = lambda v: (134217729.0 * v) - ((134217729.0 * v) - v)
    high = split(part)
    low = part - high
    p_high = F.lit(134217729.0 * power - (134217729.0 * power - power))
    p_low = F.lit(power) - p_high
    product = part * F.lit(power)
    error = ((high * p_high - product) + high * p_low + low * p_high) + low * p_low
    floor = F.floor(product).cast("double")
    rest = product - floor
    odd = (floor % 2 == 1) if digits else ((whole + floor) % 2 == 1)
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    # a product that rounding took up to the next whole number
    below = (rest == 0) & (error < 0) & (floor > 0)
    scaled = F.when(below, floor).otherwise(floor + up.cast("double")).cast("bigint")
    ten = int(power)
    carry = scaled >= ten
    big = F.floor(size / 2.0**62).cast("bigint").cast("decimal(20,0)") * F.lit(2**62).cast("decimal(19,0)") + (size % 2.0**62).cast("bigint")
    units = F.when(size < 2.0**63, (whole.cast("bigint") + carry.cast("bigint")).cast("string")).when(size < 2.0**115, big.cast("decimal(38,0)").cast("string"))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    tail = F.concat(F.lit("."), F.lpad((scaled % ten).cast("string"), digits, "0")) if digits else F.lit("")
    return F.concat(sign, units, tail)


def kept_first(values: Column) -> Column:
    """The different values of an array, each at its first place."""
    return F.array_distinct(values)


def sorted_names(values: Column) -> Column:
    """The different filled names in order, joined by a comma and a space."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(values, clean), lambda x: x != ""))), ", ")
