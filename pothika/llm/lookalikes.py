"""Problem 7: text that looks the same but is written with other characters, brought to one form.

The whole conversion is one SQL expression that DuckDB runs inside each Arrow partition, one connection a task,
one thread and no spill folder. The tables below are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that take no room; taken out.
INVISIBLE = "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{206F}\\x{FE00}-\\x{FE0F}\\x{FEFF}]"
#: Single characters and the ordinary ones that they look like.
SPACES = "               　"
HYPHENS = "‐‑‒−˗﹣﹘"
COMMAS = "‚،、﹐﹑٫"
STOPS = "․。﹒۔｡"
SINGLE_BARS = "|ǀ∣│￨❘׀"
DOUBLE_BARS = "∥‖ǁ║⏸"
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
FULL_WIDTH_AS = "".join(map(chr, range(0x21, 0x7F)))
#: Cyrillic, Greek and other letters that look like Latin ones, used where the text is Latin.
LATIN_LIKE = "аеорсхуіјѕһԁԛԝӏАВЕКМНОРСТХУІЈЅԌοαινρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡ"
LATIN_LIKE_AS = "aeopcxyijshdqwlABEKMHOPCTXYIJSGoaivpuABEZHIKMNOPTYXiag"
#: Sequences that look like one letter, and that letter; before the composition.
SEQUENCES = [
    ("||", "॥"), ("।।", "॥"), ("|।", "॥"), ("।|", "॥"),
    ("अा", "आ"), ("अो", "ओ"), ("अौ", "औ"), ("अॉ", "ऑ"), ("एे", "ऐ"), ("ाे", "ो"), ("ाै", "ौ"), ("ाॅ", "ॉ"), ("आे", "ओ"), ("आै", "औ"), ("उ॒", "ऊ"),
    ("અા", "આ"), ("અો", "ઓ"), ("અૌ", "ઔ"), ("અૉ", "ઑ"), ("અે", "એ"), ("અૈ", "ઐ"), ("ાે", "ો"), ("ાૈ", "ૌ"), ("આે", "ઓ"), ("આૈ", "ઔ"),
]
#: A vowel sign or a mark before the nukta, in both scripts: it looks as after it, but composing leaves it there.
SIGN_BEFORE_NUKTA = [("[\\x{0901}-\\x{0903}\\x{093A}\\x{093B}\\x{093E}-\\x{094C}\\x{0962}\\x{0963}]+", "\u093c"), ("[\\x{0A81}-\\x{0A83}\\x{0ABE}-\\x{0ACC}\\x{0AE2}\\x{0AE3}]+", "\u0abc")]
#: The letters and signs of both scripts, in the same order; dandas and digits stay out.
DEVANAGARI = "".join(chr(c) for c in range(0x900, 0x980) if not 0x964 <= c <= 0x96F)
GUJARATI = "".join(chr(c + 0x180) for c in range(0x900, 0x980) if not 0x964 <= c <= 0x96F)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _compatibility() -> tuple[str, str]:
    """Compatibility forms of single letters and digits (mathematical, circled, ligature halves): from, to."""
    import unicodedata

    forms = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for block in (range(0x2070, 0x209D), range(0x2100, 0x2150), range(0x2460, 0x24EA), range(0x1D400, 0x1D800)) for c in block]
    forms = [(a, b) for a, b in forms if a != b and len(b) == 1]
    return "".join(a for a, _ in forms), "".join(b for _, b in forms)


def one_form_sql(column: str) -> str:
    """The SQL expression that gives the one form of a column."""
    singles = [(SPACES, " "), (HYPHENS, "-"), (COMMAS, ","), (STOPS, ".")]
    source = "".join(a for a, _ in singles) + FULL_WIDTH + _compatibility()[0]
    target = "".join(b * len(a) for a, b in singles) + FULL_WIDTH_AS + _compatibility()[1]
    out = f"regexp_replace({column}, {_quoted(INVISIBLE)}, '', 'g')"
    for signs, nukta in SIGN_BEFORE_NUKTA:
        out = f"regexp_replace({out}, '({signs}){nukta}', '{nukta}\\1', 'g')"
    out = f"nfc_normalize(translate({out}, {_quoted(source)}, {_quoted(target)}))"
    for a, b in SEQUENCES:
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    out = f"translate({out}, {_quoted(SINGLE_BARS + DOUBLE_BARS)}, {_quoted('।' * len(SINGLE_BARS) + '॥' * len(DOUBLE_BARS))})"
    return f"replace({out}, '।।', '॥')"


def _script_sql(column: str) -> str:
    """The column with all letters in the script that most of its letters have (Devanagari, Gujarati or Latin)."""

    def n(keep: str) -> str:
        return f"length(regexp_replace({column}, '[^{keep}]', '', 'g'))"

    deva, guja = n("\\x{0900}-\\x{0963}\\x{0970}-\\x{097F}"), n("\\x{0A80}-\\x{0AE3}\\x{0AF0}-\\x{0AFF}")
    latin, like = n("A-Za-z\\x{00C0}-\\x{024F}\\x{1E00}-\\x{1EFF}"), n("\\x{0370}-\\x{052F}\\x{0131}\\x{0251}\\x{0261}")
    to_deva = f"translate({column}, {_quoted(GUJARATI)}, {_quoted(DEVANAGARI)})"
    to_guja = f"translate({column}, {_quoted(DEVANAGARI)}, {_quoted(GUJARATI)})"
    to_latin = f"translate({column}, {_quoted(LATIN_LIKE)}, {_quoted(LATIN_LIKE_AS)})"
    return f"CASE WHEN {like} > 0 AND {latin} > 0 AND {latin} >= {deva} + {guja} THEN {to_latin} WHEN {deva} > 0 AND {guja} > 0 THEN (CASE WHEN {deva} >= {guja} THEN {to_deva} ELSE {to_guja} END) ELSE {column} END"


def unified(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, text, one_form): a row for each field that is not null, with its text in the one form.

    Empty text stays empty, null fields give no row; repeated rows give repeated rows, an empty table none.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, field string, text string, one_form string"
    steps = " UNION ALL ".join(f"SELECT {key}, {_quoted(f)} AS field, {f} AS text, {one_form_sql(f)} AS s FROM batch WHERE {f} IS NOT NULL" for f in fields)
    # composing again: a letter that replaced a look-alike may compose with the accent after it
    sql = f"SELECT {key}, field, text, nfc_normalize({_script_sql('s')}) AS one_form FROM ({steps})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": "", "memory_limit": "400MB"}) as con:
            for batch in batches:
                if batch.num_rows:
                    con.register("batch", pa.Table.from_batches([batch]))
                    yield from con.execute(sql).to_arrow_table().to_batches()
                    con.unregister("batch")

    return df.select(key, *fields).mapInArrow(run, schema)


def lookalike_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of the fields whose text differs from its one form."""
    return unified(df, key, fields).filter("text <> one_form").select(key, "field")
