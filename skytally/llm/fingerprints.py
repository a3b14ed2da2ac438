"""Document fingerprints by winnowing, in SQL functions only.

Every run of ``k`` words has a hash; of every ``window`` neighbouring runs the smallest hash is kept, the rightmost
of equals, with its position. Two texts that share ``k + window - 1`` words in a row therefore share a
fingerprint. A kept run is one number: 40 bits of hash above 23 bits that fall with the position, so the plain
minimum of a window is also its rightmost.

A text of few words, or with few blanks, has runs of characters instead (``by_characters``). The text alone decides, so equal
texts have equal fingerprints. Likeness is always that of marks of one kind: where the edited or the next text has the other
kind, it is marked as the text is for that. Positions are told apart up to 8,388,608 runs and begin again after that.

Neighbours in ``doc_id`` order are found without a global window: rows go to buckets between approximate
quantiles of the id (a number of buckets that follows the row count), and the first row of every bucket is
sent to the one before as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skytally.operators.stages import compute_once

POSITION_BITS = 23
TOP = (1 << POSITION_BITS) - 1
#: Runs and windows of texts marked by characters.
CHARACTERS, CHARACTER_WINDOW = 4, 4
BLANKS = r"'[ \\t\\n\\u000B\\f\\r]+'"


def by_characters(text: str, k: int = 4, window: int = 8) -> str:
    """SQL for whether a text has under ``k + 2 * window`` words, or a blank or new line less often than every 32 characters."""
    least = k + 2 * window
    words = f"size(filter(split({text}, {BLANKS}, {least + 2}), w -> w != ''))"
    return f"({words} BETWEEN 1 AND {least - 1} OR {words} > 0 AND 32 * (length({text}) - length(replace(replace({text}, ' ', ''), '\\n', ''))) < length({text}))"


def winnowed(text: str, k: int = 4, window: int = 8, characters: bool = False) -> dict[str, str]:
    """SQL stages, in order, that turn the string column ``text`` into ``{text}_marks``: the kept runs as an array of longs.

    Fewer than ``k`` words make one run, fewer than ``window`` runs one window, no words an empty array.
    With ``characters`` every character counts as a word.
    """
    words, hashes, grams = f"{text}_words", f"{text}_hashes", f"{text}_grams"
    run = ", ".join(f"get({hashes}, i + {j})" for j in range(k))
    last = ", ".join(f"get({grams}, i + {j})" for j in range(window))
    pack = "shiftleft({0} & 1099511627775, {1}) | ({2} - i % {3})"
    return {
        words: f"filter(split({text}, {"''" if characters else BLANKS}), w -> w != '')",
        hashes: f"transform({words}, w -> xxhash64(w))",
        grams: f"""CASE WHEN size({hashes}) = 0 THEN cast(array() AS array<bigint>)
            WHEN size({hashes}) < {k} THEN array(shiftleft(xxhash64({hashes}) & 1099511627775, {POSITION_BITS}) | {TOP})
            ELSE transform(sequence(0, size({hashes}) - {k}), i -> {pack.format(f"xxhash64({run})", POSITION_BITS, TOP, TOP + 1)}) END""",
        f"{text}_marks": f"""CASE WHEN size({grams}) = 0 THEN {grams} WHEN size({grams}) <= {window} THEN array(array_min({grams}))
            ELSE array_distinct(transform(sequence(0, size({grams}) - {window}), i -> {f"least({last})" if window > 1 else last})) END""",
    }


def with_marks(df: DataFrame, text: str, k: int = 4, window: int = 8, characters: bool = False) -> DataFrame:
    """``df`` with ``{text}_marks``; the steps in between are not kept."""
    columns = df.columns
    stages = list(winnowed(text, k, window, characters).items())
    for i, (name, sql) in enumerate(stages):
        df = compute_once(df, {name: sql})
        df = df.drop(stages[i - 1][0]) if i else df
    return df.select(*[f"`{c}`" for c in columns], stages[-1][0])


def with_own_marks(df: DataFrame, text: str, close: str, k: int, window: int) -> DataFrame:
    """``df`` with ``{text}_marks``, of characters where the column ``close`` holds and of words elsewhere."""
    columns = [f"`{c}`" for c in df.columns]
    df = compute_once(df, {"spaced": f"if({close}, '', {text})", "unspaced": f"if({close}, {text}, '')"})
    df = with_marks(df, "spaced", k, window).drop("spaced")
    df = with_marks(df, "unspaced", CHARACTERS, CHARACTER_WINDOW, characters=True)
    return df.selectExpr(*columns, f"if({close}, unspaced_marks, spaced_marks) AS {text}_marks")


def spans(df: DataFrame, marks: str) -> DataFrame:
    """One row per kept run: the columns but ``marks``, and ``hash`` and ``position`` (number of the run's first word)."""
    kept = [f"`{c}`" for c in df.columns if c != marks]
    rows = df.selectExpr(*kept, f"explode({marks}) AS __mark")
    return rows.selectExpr(*kept, f"shiftright(__mark, {POSITION_BITS}) AS hash", f"{TOP} - (__mark & {TOP}) AS position")


def written(marks: str) -> F.Column:
    """Marks as text: ``hash@position`` with blanks between, in order."""
    return F.expr(f"array_join(transform({marks}, x -> concat(shiftright(x, {POSITION_BITS}), '@', {TOP} - (x & {TOP}))), ' ')")


def likeness(one: str, other: str) -> F.Column:
    """Share of the distinct hashes of both sides that both have; 1 if neither has any."""
    a, b = (f"transform({m}, x -> shiftright(x, {POSITION_BITS}))" for m in (one, other))
    both, every = f"size(array_intersect({a}, {b}))", f"size(array_union({a}, {b}))"
    return F.expr(f"if(size({one}) = 0 AND size({other}) = 0, 1.0D, {both} / {every})").cast("double")


def cuts_of(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """At most ``buckets`` - 1 values of the long column ``key`` that split the rows about evenly, in order."""
    if buckets < 2:
        return []
    shares = ", ".join(repr(i / buckets) for i in range(1, buckets))
    found = rows.selectExpr(f"percentile_approx({key}, array({shares}), {max(10_000, 20 * buckets)}) AS cuts").first()["cuts"]
    return sorted(set(found or []))


def with_bucket(rows: DataFrame, key: str, cuts: list[int]) -> DataFrame:
    """Adds ``bucket``: how many of ``cuts`` are at most ``key``, counted in two steps."""
    if not cuts:
        return rows.withColumn("bucket", F.lit(0))
    step = max(1, int(len(cuts) ** 0.5))

    def array(values):
        return f"cast(split('{','.join(map(str, values))}', ',') AS array<bigint>)"

    rows = compute_once(rows, {"coarse": f"{step} * size(filter({array(cuts[step - 1::step])}, x -> x <= {key}))"})
    return rows.withColumn("bucket", F.expr(f"coarse + size(filter(slice({array(cuts)}, coarse + 1, {step}), x -> x <= {key}))")).drop("coarse")


def with_guests(docs: DataFrame, rows_per_bucket: int = 1_000, most_buckets: int = 10_000) -> DataFrame:
    """``doc_id``, ``text`` (null: empty), ``ord``, ``bucket`` and ``guest``: every bucket has its rows and, as guests, those that
    begin the next one; after the last bucket comes the first. Missing ids come first."""
    rows = docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "coalesce(cast(text AS string), '') AS text", "coalesce(cast(doc_id AS bigint), -9223372036854775808L) AS ord")
    buckets = max(1, min(most_buckets, -(-docs.count() // rows_per_bucket)))
    cuts = cuts_of(rows.select("ord"), "ord", buckets)
    firsts = with_bucket(rows.select("ord"), "ord", cuts).groupBy("bucket").agg(F.min("ord").alias("first"))
    in_order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select(F.coalesce(F.lead("first").over(Window.orderBy("bucket")), F.first("first").over(in_order)).alias("ord"), F.col("bucket").alias("host"))
    hosted = with_bucket(rows, "ord", cuts).join(F.broadcast(following), "ord", "left")  # one row per bucket at most
    return hosted.selectExpr("doc_id", "text", "ord", "inline(if(host IS NULL, array(struct(bucket AS bucket, false AS guest)), "
                             "array(struct(bucket AS bucket, false AS guest), struct(host AS bucket, true AS guest))))")


def fingerprints(docs: DataFrame, k: int = 4, window: int = 8, rows_per_bucket: int = 1_000) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text has the last floor(n / 2) code points replaced by as many first ones of the next document in
    ``doc_id`` order (equal ids: in order of text), the first after the last. Null text counts as empty. Columns:
    ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``. Repeated rows
    stay; other columns are left behind; an empty table gives no rows.
    """
    rows = with_guests(docs, rows_per_bucket)
    near = Window.partitionBy("bucket").orderBy("guest", "ord", "text")
    rows = compute_once(rows, {"close": by_characters("text", k, window)})
    rows = with_own_marks(rows.withColumn("next_text", F.lead("text").over(near)), "text", "close", k, window)
    rows = rows.withColumns({"next_marks": F.lead("text_marks").over(near), "next_close": F.lead("close").over(near)}).where("NOT guest")
    rows = rows.selectExpr("doc_id", "text", "next_text", "close", "text_marks", "if(close = next_close, next_marks, null) AS next_marks",
                           "if(close = next_close, '', next_text) AS other", "length(text) AS n_chars")
    rows = with_own_marks(rows, "other", "close", k, window).withColumn("next_marks", F.coalesce("next_marks", "other_marks")).drop("other", "other_marks")
    rows = compute_once(rows, {"edited": "concat(left(text, n_chars - n_chars div 2), left(next_text, n_chars div 2))"}).drop("text", "next_text")
    rows = compute_once(with_own_marks(rows, "edited", "close", k, window), {"edited_close": by_characters("edited", k, window)})
    rows = with_own_marks(rows.withColumn("strange", F.expr("if(edited_close = close, '', edited)")), "strange", "edited_close", k, window)
    rows = rows.withColumn("printed_marks", F.expr("if(edited_close = close, edited_marks, strange_marks)"))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written("text_marks").alias("fingerprint"), written("printed_marks").alias("edited_fingerprint"),
        likeness("text_marks", "edited_marks").alias("near_edited"), likeness("text_marks", "next_marks").alias("near_next"))
