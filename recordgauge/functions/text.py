"""String and number expressions. White space means Unicode white space unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordgauge.functions.fields import DENSE_MARKS, SPARSE_MARKS

QUOTES = (('"', '"'), ("'", "'"), ("`", "`"), ("“", "”"), ("‘", "’"))
PUNCTUATION = "[](){}<>.,;:"
ID_PREFIX = r"(?i)\A(?:imageid|seriesid|image|img|series|ser|id)[\s:_#-]*"
TOKEN = "A-Za-z0-9_"


def bound(c: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse_ws(c: Column | str) -> Column:
    """T-1."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_outer_quotes(c: Column, depth: int = 4) -> Column:
    """T-2: up to `depth` nested pairs. Each step names its input once, so that the expression stays small."""
    pairs = "|".join(f"{a}(.*){b}" for a, b in QUOTES)
    c = strip(c)
    for _ in range(depth):
        c = strip(F.regexp_replace(c, rf"(?s)\A(?:{pairs})\z", "".join(f"${k + 1}" for k in range(len(QUOTES)))))
    return c


def strip_outer_punct(c: Column) -> Column:
    """T-3."""
    return F.btrim(strip(c), F.lit(PUNCTUATION))


def clean_id(c: Column) -> Column:
    """T-4: null gives ''."""
    return strip(strip_outer_punct(strip_outer_quotes(collapse_ws(F.coalesce(c.cast("string"), F.lit(""))))))


def id_format(c: Column) -> Column:
    """T-5: empty, numeric, alphanumeric (letters and digits) or other."""
    mixed = c.rlike(r"\A[A-Za-z0-9]+\z") & c.rlike("[A-Za-z]") & c.rlike("[0-9]")
    return F.when(c == "", "empty").when(c.rlike(r"\A[0-9]+\z"), "numeric").when(mixed, "alphanumeric").otherwise("other")


def digits_only(c: Column) -> Column:
    """T-6."""
    return F.regexp_replace(c, "[^0-9]", "")


def strip_leading_zeros(c: Column) -> Column:
    """T-7: of digit strings; '000' gives '0'."""
    return F.when(c.rlike(r"\A[0-9]+\z"), F.regexp_replace(c, r"\A0+(?=.)", "")).otherwise(c)


def strip_id_prefix(c: Column) -> Column:
    """T-8."""
    return strip(F.regexp_replace(clean_id(c), ID_PREFIX, ""))


def compact(c: Column) -> Column:
    """T-9."""
    return F.regexp_replace(c, r"(?U)[\s\-_:/#]+", "")


def literal(c: Column) -> Column:
    """A regular expression that matches the string itself."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def token_pattern(value: Column, ignore_case: bool = False) -> Column:
    """T-10: the value between non-token characters."""
    return F.concat(F.lit(f"{'(?i)' if ignore_case else ''}(?<![{TOKEN}])"), literal(value), F.lit(f"(?![{TOKEN}])"))


def token_position(text: Column, value: Column, ignore_case: bool = False) -> Column:
    """1-based start of the token in the text; 0 without one."""
    return F.regexp_instr(text, token_pattern(value, ignore_case))


def match_ladder(df: DataFrame, text: str, value: str) -> DataFrame:
    """T-11: `df` with `id_clean`, `matched_by` (the first rung that holds) and the span (0-based, null if unknown).

    The steps are columns of their own, so that each is computed once."""
    df = df.withColumns({"__text": F.coalesce(F.col(text), F.lit("")), "id_clean": clean_id(F.col(value))})
    df = df.withColumns({"__flat": collapse_ws("__text"), "__small": compact(F.col("id_clean")), "__bare": strip_id_prefix(F.col("id_clean")), "__digits": digits_only(F.col("id_clean"))})
    df = df.withColumns({"__short": strip_leading_zeros(F.col("__digits")), "__tight": compact(F.col("__text"))})
    t, val, flat, bare = F.col("__text"), F.col("id_clean"), F.col("__flat"), F.col("__bare")
    digits, short, some = F.col("__digits"), F.col("__short"), F.col("id_clean") != ""
    rungs = [
        ("strict_token", some, token_position(t, val), val),
        ("strict_ws_token", some, token_position(flat, val), val),
        ("relaxed_casefold", some, token_position(t, val, True), val),
        ("relaxed_compact", some & (F.col("__small") != ""), token_position(F.col("__tight"), F.col("__small"), True), None),
        ("relaxed_prefix_stripped", some & (bare != "") & (bare != val), F.greatest(token_position(t, bare, True), token_position(flat, bare, True)), bare),
        ("relaxed_digits", some & (digits != ""), token_position(t, digits), digits),
        ("relaxed_digits_no_zeros", some & (short != "") & (short != digits), token_position(t, short), short),
    ]
    found = F.lit(None).cast("struct<matched_by:string,span_start:int,span_end:int>")
    for rung, holds, at, what in reversed(rungs):
        none = F.lit(None).cast("int")
        start = at - 1 if what is not None else none
        end = at - 1 + F.char_length(what) if what is not None else none
        hit = F.struct(F.lit(rung).alias("matched_by"), start.alias("span_start"), end.alias("span_end"))
        found = F.when(holds & (at > 0), hit).otherwise(found)
    df = df.withColumn("__found", found)
    out = df.withColumns({"matched_by": F.coalesce("__found.matched_by", F.lit("none")), "span_start": F.col("__found.span_start"), "span_end": F.col("__found.span_end")})
    return out.drop("__text", "__flat", "__small", "__bare", "__digits", "__short", "__tight", "__found")


def context_excerpt(text: Column, start: Column, end: Column, width: int = 120) -> Column:
    """T-12."""
    text = F.coalesce(text, F.lit(""))
    low = F.greatest(F.lit(0), start - width)
    around = F.substring(text, low + 1, end + width - low)
    return F.when(start.isNull() | end.isNull(), F.substring(collapse_ws(text), 1, 2 * width)).otherwise(collapse_ws(around))


def sha256_text(c: Column) -> Column:
    """T-13."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def has_all(c: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for m in marks:
        out = out & c.contains(m)
    return out


def classify_instruction(c: Column, sparse_marks=SPARSE_MARKS, dense_marks=DENSE_MARKS) -> Column:
    """T-14."""
    c = F.coalesce(c, F.lit(""))
    sparse, dense = has_all(c, sparse_marks), has_all(c, dense_marks)
    return F.when(sparse & dense, "conflicting_sparse_and_dense").when(sparse, "sparse_omit_null").when(dense, "dense_nullable").otherwise("unrecognized")


def occurrences(c: Column, phrase: str) -> Column:
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def rewrite_once(c: Column, pairs: list[tuple[str, str]], forbidden: tuple[str, ...] = (), required: tuple[str, ...] = (), strict: bool = True) -> Column:
    """T-15: each phrase occurs exactly once and is replaced; a text already rewritten stays.

    Where that fails, or a clause check does: an error, or null if not strict."""
    ready, out = F.lit(True), c
    done = F.lit(True)
    for old, new in pairs:
        ready = ready & (occurrences(c, old) == 1)
        done = done & (occurrences(c, old) == 0) & (occurrences(c, new) == 1)
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.when(done, c).when(ready, out)
    for m in forbidden:
        out = F.when(~out.contains(m), out)
    for m in required:
        out = F.when(out.contains(m), out)
    return F.coalesce(out, F.raise_error(F.lit("instruction can't be rewritten")).cast("string")) if strict else out


def first_difference(a: Column, b: Column) -> Column:
    """T-16: 0-based place of the first differing character; null if equal."""
    at = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(a == b, None).otherwise(at - 1)


def first_token_difference(a: Column, b: Column) -> Column:
    """T-16 over arrays of tokens."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(at > 0, at - 1)


def runaway_suffix(c: Column, threshold: int = 64) -> Column:
    """T-17: a block of 1 to 32 characters, not blank, repeated to the end max(8, ceil(threshold / period)) times."""
    lengths = {p: p * max(8, -(-threshold // p)) for p in range(1, 33)}

    def loops(tail: Column) -> Column:
        out = F.lit(False)
        for p, size in lengths.items():
            # what repeats a block of p is itself again p characters on
            end = F.right(tail, F.lit(size))
            again = F.left(end, F.lit(size - p)) == F.right(tail, F.lit(size - p))
            out = out | ((F.char_length(tail) >= size) & again & F.right(tail, F.lit(p)).rlike(r"(?U)\S"))
        return out

    return bound(F.right(F.coalesce(c, F.lit("")), F.lit(max(lengths.values()))), loops)


def user_text(instruction: Column, given: Column) -> Column:
    """Instruction, then a blank line and the input if there is one."""
    return F.concat_ws("\n\n", strip(F.coalesce(instruction, F.lit(""))), F.nullif(strip(given), F.lit("")))


def case_id(names: list[str], columns: list[str], index: Column) -> Column:
    """The first of `names` that is a column and not null, else the row's index."""
    return F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in columns], index.cast("string"))


def round_up(v: Column, multiple: int) -> Column:
    """M-1."""
    if multiple <= 0:
        raise ValueError("multiple must be positive")
    return (F.ceil(v / multiple) * multiple).cast("long")


def plausible_context(v: Column) -> Column:
    """M-2."""
    return F.when(v.between(1, 9_999_999), v)


#: Where a model's configuration states its context, in order of preference (fixed values).
CONTEXT_KEYS = (
    "text_config.max_position_embeddings",
    "config.max_position_embeddings",
    "text_config.max_sequence_length",
    "config.max_sequence_length",
    "text_config.seq_length",
    "config.seq_length",
    "text_config.n_positions",
    "config.n_positions",
    "tokenizer.model_max_length",
)


def native_context(columns: list[str]) -> Column:
    """M-3: the first plausible of CONTEXT_KEYS among the columns."""
    return F.coalesce(*[plausible_context(F.col(f"`{k}`")) for k in CONTEXT_KEYS if k in columns], F.lit(None).cast("long"))


def safe_div(a: Column, b: Column) -> Column:
    """M-4: 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def short_feature(c: Column) -> Column:
    """A feature's name without the list's, underscores as spaces."""
    return F.replace(F.regexp_replace(c, r"\ANodules\.", ""), F.lit("_"), F.lit(" "))


def rounded_text(c: Column, digits: int, form: str = "%.{}f") -> Column:
    """A number with fixed decimals, ties to the even digit (as the C library prints them); zero keeps its sign."""
    c = c.cast("double")
    near = F.bround(c, digits)
    return F.format_string(form.format(digits), F.when((near == 0) & ((c < 0) | (F.hex(c.cast("string")) == F.hex(F.lit("-0.0")))), F.lit(-0.0)).otherwise(near))


def fixed(c: Column, digits: int = 4) -> Column:
    """Fixed decimals; null gives ''."""
    return F.when(c.isNull(), "").otherwise(rounded_text(c, digits))


def signed(c: Column, digits: int = 2) -> Column:
    """A change with its sign."""
    return rounded_text(c, digits, "%+.{}f")


def spanned(point: Column, low: Column, high: Column) -> Column:
    return F.concat(point, F.lit(" ("), low, F.lit(", "), high, F.lit(")"))


def interval_text(point: Column, low: Column, high: Column, digits: int = 3) -> Column:
    """N19: 'point (low, high)'."""
    return spanned(*[rounded_text(c, digits) for c in (point, low, high)])


def change_text(point: Column, low: Column, high: Column, digits: int = 2) -> Column:
    """A change and its interval in points, signed."""
    return spanned(*[signed(100 * c, digits) for c in (point, low, high)])
