"""Fill-in-the-middle: prefix, middle and suffix of a text change places, cut between tokens.

A token is a run of ASCII letters or one other character. Whether a token starts at a character depends on that character
and the one before alone, so a text is decomposed into chunks that overlap by one character, and the starts in each chunk
are counted apart from the others. Sums over the counts give each chunk the rank of its first token; each of the two cut
ranks goes to the chunk that owns it, and only the owning chunks are scanned a second time, for the cut's exact place.

Everything is a column expression on the row that holds the text: a text isn't sent anywhere, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_TOKEN = "[A-Za-z]+|[^A-Za-z]"
#: The predicate on adjacent characters: letters after a letter start no token. Without them a text has a character a token.
_WITHIN = "(?<=[A-Za-z])[A-Za-z]+"
_REST = 2_147_483_647


def text_chunks(text: Column, chars: int = CHUNK_CHARS) -> Column:
    """The text in pieces of `chars` characters (the last may be shorter)."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % chars), F.lit(0))


def overlapping(chunks: Column) -> Column:
    """Each piece with the last character of the one before in front; a space before the first."""
    before = F.concat(F.array(F.lit(" ")), F.transform(chunks, lambda c: F.right(c, F.lit(1))))
    return F.zip_with(F.slice(before, F.lit(1), F.size(chunks)), chunks, lambda b, c: F.concat(b, c))


def chunk_counts(overlapped: Column) -> Column:
    """Token starts in each overlapping piece, without its first character, which always looks like a start."""
    return F.transform(overlapped, lambda c: F.length(F.regexp_replace(c, _WITHIN, "")) - 1)


def owners(counts: Column, ranks: list[Column]) -> list[Column]:
    """For each rank, the number of the piece that owns it (from 0) and the tokens that start before that piece.

    The owner of rank r is the first piece up to whose end more than r tokens start; where there is none, the rank is
    that of the text's end, and the number is that of the pieces.
    """
    start = F.struct(F.lit(0).alias("seen"), *[F.struct(F.lit(0).alias("piece"), F.lit(0).alias("before"), F.lit(False).alias("found")).alias(f"r{i}") for i in range(len(ranks))])

    def step(held, n):
        moved = []
        for i, rank in enumerate(ranks):
            own = held[f"r{i}"]
            here = ~own["found"] & (held["seen"] + n > rank)
            moved.append(
                F.struct(
                    F.when(own["found"] | here, own["piece"]).otherwise(own["piece"] + 1).alias("piece"),
                    F.when(here, held["seen"]).otherwise(own["before"]).alias("before"),
                    (own["found"] | here).alias("found"),
                ).alias(f"r{i}")
            )
        return F.struct((held["seen"] + n).alias("seen"), *moved)

    routed = F.aggregate(counts, start, step)
    return [routed[f"r{i}"] for i in range(len(ranks))]


def place_in(overlapped: Column, rank: Column) -> Column:
    """Characters of an overlapping piece, its first one aside, before the token start of this rank (from 0) in it.

    A run of letters that began in the piece before is no start; its letters come before the first one.
    """
    tokens = F.regexp_extract_all(F.substring(overlapped, 2, _REST), F.lit(_TOKEN), F.lit(0))
    running = F.when(overlapped.rlike("^[A-Za-z]{2}"), 1).otherwise(0)
    return F.aggregate(F.slice(tokens, F.lit(1), rank + running), F.lit(0), lambda n, t: n + F.length(t))


def drawn(doc_id: Column) -> list[Column]:
    """Four numbers from 0 to 2^32 - 1 that depend on the id alone; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arranged(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).otherwise(spm)


def _parted(text: Column, mark: Column) -> tuple[Column, Column]:
    """What comes before the first place of a mark of three characters, and what comes after it."""
    at = F.instr(text, mark)
    return F.substring(text, F.lit(1), at - 1), F.substring(text, at + 3, F.lit(_REST))


def restored(form: Column, output: Column) -> Column:
    """The text that an output of this form came from."""
    body = F.substring(output, 4, _REST)  # after the first mark
    first, rest = _parted(body, F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)))
    last, middle = _parted(rest, F.lit(MIDDLE))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, last)).otherwise(F.concat(last, middle, first))


def fill_in_middle(docs: DataFrame, plain_from: int = 90, spm_below: int = 20, chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows (doc_id, text, n, form, prefix_chars, middle_chars, output), one for each row of docs (doc_id, text, …).

    n counts tokens. form is plain, psm or spm; a plain output is the text, and its two lengths are null. Texts that are
    empty or hold a mark are plain; of the others, those whose third draw modulo 100 is `plain_from` or more are, and of
    the rest those whose fourth draw modulo 100 is below `spm_below` are spm. The draws depend on the id, so repeated
    rows give equal rows. A null text counts as empty, a null doc_id as one without digits and stays null. Other columns
    are ignored; an empty table gives no rows.
    """
    h1, h2, h3, h4 = drawn(F.col("doc_id"))
    held = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    cut = held.withColumn("_pieces", overlapping(text_chunks(F.col("text"), chars)))
    cut = cut.withColumn("_counts", chunk_counts(F.col("_pieces")))
    cut = cut.withColumn("n", F.aggregate("_counts", F.lit(0).cast("long"), lambda a, b: a + b))
    cut = cut.withColumn("_a", F.pmod(h1, F.col("n") + 1)).withColumn("_b", F.pmod(h2, F.col("n") + 1))
    cut = cut.withColumn("_low", F.least("_a", "_b").cast("int")).withColumn("_high", F.greatest("_a", "_b").cast("int"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.pmod(h3, F.lit(100)) >= plain_from)
    cut = cut.withColumn("form", F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < spm_below, "spm").otherwise("psm"))
    cut = cut.withColumn("_owners", F.array(*owners(F.col("_counts"), [F.col("_low"), F.col("_high")])))

    def place(i: int, rank: str) -> Column:
        own = F.col("_owners")[i]
        inside = place_in(F.get("_pieces", own["piece"]), F.col(rank) - own["before"])
        return F.when(own["found"], own["piece"] * chars + inside).otherwise(F.length("text"))

    split = F.col("form") != "plain"
    cut = cut.withColumn("prefix_chars", F.when(split, place(0, "_low")).cast("long"))
    cut = cut.withColumn("middle_chars", F.when(split, place(1, "_high") - F.col("prefix_chars")).cast("long"))
    size, after = F.col("prefix_chars").cast("int"), (F.col("prefix_chars") + F.col("middle_chars")).cast("int")
    prefix = F.substring("text", F.lit(1), size)
    middle, suffix = F.substring("text", size + 1, F.col("middle_chars").cast("int")), F.substring("text", after + 1, F.lit(_REST))
    cut = cut.withColumn("output", F.when(split, arranged(F.col("form"), prefix, middle, suffix)).otherwise(F.col("text")))
    return cut.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output")
