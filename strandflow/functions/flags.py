"""The cluster flag word: names of its bits, and Column helpers over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit numbers of the flag word.
NAMES = (
    "PASS", "ASSEMBLED", "LEFT_FLANK_MAP", "RIGHT_FLANK_MAP", "DIFF_FLANK_MAP", "SAME_FLANK_MAP", "TE_MAP", "POLYA", "TSD",
    "5P_FULL", "3P_FULL", "5P_UNKNOWN", "3P_UNKNOWN", "SINGLE_TE", "SELF_TO_SELF", "LINE", "SINE", "RETROPOSON", "LTR", "DNA",
    "AT_RICH", "LEFT_NEAR_END", "RIGHT_NEAR_END", "SOLO_LTR", "SECONDARY", "POLYA_ONLY",
)
BIT = {name: 1 << i for i, name in enumerate(NAMES)}
CLASSES = ("LINE", "SINE", "RETROPOSON", "LTR", "DNA")
RETRO = ("LINE", "SINE", "RETROPOSON")
# Segment types.
LEFT_CLIP, MID_INSERT, RIGHT_CLIP = 1, 2, 4


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


def has(flag: Column, *names: str) -> Column:
    """Any of these bits is set."""
    return flag.bitwiseAND(F.lit(mask(*names)).cast("long")) != 0


def bits_if(**conditions: Column) -> Column:
    """The sum of the bits whose condition holds; a leading underscore is dropped from names (``_5P_FULL``)."""
    out = F.lit(0).cast("long")
    for name, condition in conditions.items():
        out = out + F.when(condition, F.lit(BIT[name.lstrip("_")])).otherwise(F.lit(0)).cast("long")
    return out


def class_bit(name: Column) -> Column:
    """The bit of a class name; 0 for any other name."""
    return F.coalesce(*(F.when(name == c, F.lit(BIT[c])) for c in CLASSES), F.lit(0)).cast("long")


def class_label(flag: Column) -> Column:
    return F.when(has(flag, "DNA"), "DNA").when(has(flag, "LTR"), "LTR").when(has(flag, "LINE"), "LINE").when(has(flag, "SINE"), "SINE").when(has(flag, "RETROPOSON"), "Retroposon").otherwise("unknown")


def ends_label(flag: Column) -> Column:
    return F.when(has(flag, "LEFT_FLANK_MAP"), "only_left").when(has(flag, "RIGHT_FLANK_MAP"), "only_right").when(has(flag, "DIFF_FLANK_MAP", "SAME_FLANK_MAP"), "both_end").otherwise("unknown")


def truncation_label(flag: Column) -> Column:
    """Which ends of the element are there; the spelling of two labels is part of the data contract."""
    five, three, no5, no3 = (has(flag, n) for n in ("5P_FULL", "3P_FULL", "5P_UNKNOWN", "3P_UNKNOWN"))
    return (
        F.when(five & three, "full").when(five, F.when(no3, "3p_unknown").otherwise("3p_turncated"))
        .when(three, F.when(no5, "5p_unknown").otherwise("5p_turncated")).when(no3 & no5, "5p3p_unknown").otherwise("5p3p_truncated")
    )


BOOLEANS = {"passed": "PASS", "assembled": "ASSEMBLED", "has_polya": "POLYA", "has_tsd": "TSD", "singleton": "SINGLE_TE", "self2self": "SELF_TO_SELF", "solo_ltr": "SOLO_LTR"}


def decoded(flag: Column) -> list[Column]:
    """All columns that a flag word stands for."""
    return [*(has(flag, bit).alias(name) for name, bit in BOOLEANS.items()), ends_label(flag).alias("reconstructed_ends"), truncation_label(flag).alias("truncation"), class_label(flag).alias("te_class")]


def genotype(frequency: Column) -> Column:
    """By the frequency as printed, with six digits."""
    f = F.round(frequency, 6)
    return F.when(f < 0.2, "0/0").when(f >= 0.8, "1/1").otherwise("0/1")


def _python_bool(c: Column) -> Column:
    return F.initcap(c.cast("string"))


def extra_info() -> Column:
    """Key=value pairs, comma-joined, of the columns that `decoded` and the cluster table name."""
    # Keys of the text, each with its column; booleans are spelled True and False.
    pairs = (
        ("insID", "insertion_id"), ("leftClipReads", "leftclip_reads"), ("spanningReads", "spanning_reads"), ("rightClipReads", "rightclip_reads"), ("teClass", "te_class"),
        ("assembled", "assembled"), ("truncation", "truncation"), ("reconstructedEnds", "reconstructed_ends"), ("hasPolyA", "has_polya"), ("hasTSD", "has_tsd"),
        ("singleton", "singleton"), ("self2self", "self2self"), ("soloLTR", "solo_ltr"),
    )
    shown = [F.concat(F.lit(f"{key}="), F.coalesce(_python_bool(F.col(c)) if c in BOOLEANS else F.col(c).cast("string"), F.lit(""))) for key, c in pairs]
    return F.concat_ws(",", *shown)


def post_filter(flag: Column, clt_type: Column) -> Column:
    """The bits PASS, SECONDARY and POLYA_ONLY that class rules add to a flag word."""
    cls = flag.bitwiseAND(F.lit(mask(*CLASSES)).cast("long"))
    retro, ltr = cls.isin(*(BIT[c] for c in RETRO)), cls == BIT["LTR"]
    left, right = has(flag, "LEFT_NEAR_END"), has(flag, "RIGHT_NEAR_END")
    ends, full, free, single = left & right, has(flag, "5P_FULL") & has(flag, "3P_FULL"), ~has(flag, "SELF_TO_SELF"), has(flag, "SINGLE_TE")
    tail = has(flag, "POLYA", "AT_RICH")
    other = (has(flag, "TSD") | free) & ends
    passed = F.when(retro, (tail & ends) | (free & full & single & ends)).when(ltr, (full | has(flag, "SOLO_LTR")) & other).otherwise(full & other)
    low = (clt_type != 0) & single & ends
    second = low & ((has(flag, "5P_FULL") & has(flag, "3P_UNKNOWN")) | (~retro & has(flag, "5P_UNKNOWN") & has(flag, "3P_FULL")))
    return bits_if(PASS=passed, SECONDARY=second, POLYA_ONLY=retro & has(flag, "POLYA") & (left != right))
