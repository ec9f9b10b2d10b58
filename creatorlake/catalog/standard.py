"""Texts in standard encoding, and the cleaning run that starts from it.

Some letters of the inputs are replaced by forms that composition joins, reorders or replaces; the same is done in SQL."""

from __future__ import annotations

from creatorlake.catalog import inputs
from creatorlake.catalog.cleaning import PROFILE_RULES
from creatorlake.catalog.registry import query
from creatorlake.functions import encoding
from creatorlake.plans.cleaning import clean

# Decomposed letters, marks out of order, conjoining syllables, a character that stands for another, one that never composes.
FORMS = {"a": [0x61, 0x308], "e": [0x65, 0x301, 0x323], "o": [0x1112, 0x1161, 0x11AB], "u": [0x212B], "x": [0x915, 0x93C]}
PADS = [[0x09, 0x20, 0xA0], [0x3000, 0x0A, 0x2028]]
BLANKS = " || ".join(f"chr({c})" for c in encoding.WHITE_SPACE)


def _chars(function: str, codes: list[int]) -> str:
    return " || ".join(f"{function}({c})" for c in codes)


def _odd(text: str, function: str) -> str:
    for letter, codes in FORMS.items():
        text = f"replace({text}, '{letter}', {_chars(function, codes)})"
    return text


def _padded(text: str, function: str) -> str:
    return f"{_chars(function, PADS[0])} || {text} || {_chars(function, PADS[1])}"


def _letters(text: str) -> str:
    """The same forms in Spark, where ``char`` ends at U+00FF."""
    for letter, codes in FORMS.items():
        text = f"replace({text}, '{letter}', '{''.join(map(chr, codes))}')"
    return text


BEFORE, AFTER = ("".join(f"\\u{c:04x}" for c in pad) for pad in PADS)


@query(f"SELECT doc_id, nfc_normalize(trim({_padded(_odd('text', 'chr'), 'chr')}, {BLANKS})) AS normal FROM documents")
def standard_text(spark, sf_dir):
    df = inputs.table(spark, sf_dir, "documents").selectExpr("doc_id", f"concat('{BEFORE}', {_letters('text')}, '{AFTER}') AS raw")
    return df.selectExpr("doc_id", f"{encoding.standard('raw')} AS normal")


def _profile_captures(spark, sf_dir):
    """Every customer's record twice: as it is, and later with blanks around its texts and a decomposed letter in its name."""
    plain = inputs.profile_records(spark, sf_dir)
    keys = "user_id|username|display_name|signature|secUid"
    blanks = rf"""regexp_replace(to_json(record), r'"({keys})":"([^"]*)"', concat(r'"$1":"\\t ', '$2{chr(0x3000)}', r'\\n"'))"""
    odd = plain.selectExpr("record_pos + 1000000000000 AS record_pos", f"parse_json(replace({blanks}, 'customer', 'custome\u0301r')) AS record")
    return plain.unionByName(odd)


@query(f"""
    SELECT CAST(c_custkey AS VARCHAR) AS tiktok_id, c_name AS username, 'sec' || c_custkey AS sec_uid,
        replace(lower(c_name), 'customer', 'custom' || chr(233) || 'r') AS display_name, c_mktsegment AS bio_text
    FROM customer WHERE {PROFILE_RULES} = ''""")
def standard_profiles(spark, sf_dir):
    records = _profile_captures(spark, sf_dir)
    tables = clean(records, inputs.post_records(spark, sf_dir), inputs.comment_records(spark, sf_dir), inputs.RUN_TS, standard=True)
    return tables.influencers.select("tiktok_id", "username", "sec_uid", "display_name", "bio_text")
