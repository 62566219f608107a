"""Quotation linking: messages that quote others become conversations without quotes.

The lines of a message have a quote level, the number of ``>`` ahead of them; lines of one level in
a row are a passage. Own passages (level 0), whole, by paragraph and by line, are hashed in
normalised form (lower case, white space as one blank), and each hash's original is the first
message of its scope that has it. Quoted passages are hashed likewise, whole and by line, and joined
to the originals. A message replies to the original of its shallowest quote that is found, a whole
passage ahead of a line. Following replies up gives the message that a conversation begins with;
within a conversation every message comes after the one that it replies to.

Hashes are aggregated to one original each before they are joined, so a passage that very many
messages have makes no pairs, and no conversation is gathered in one place: rows carry their place.

Nulls: a null text is the empty one; null scopes, ids and roles are values like others. A message
without a quote that is found begins a conversation. Messages of equal scope and place count as one
when they are quoted, and are rows each in the result. Columns other than those named are dropped.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordercash.llm.common import spread, written

#: Marks and blanks up to the last mark. A class is matched in a loop; a repeated group would take a
#: level of the matcher's stack for each mark.
QUOTE = r"^[ \t>]*>"
BREAK, LEVEL = "\x01", "\x02"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x20]+", " "))


def parsed(messages: DataFrame, scope: str, place: str, text: str, role: str | None = None) -> DataFrame:
    """scope, place, role, ``own`` (text without quotes) and ``passages`` (level, text)."""
    lines = messages.select(
        F.col(scope).alias("scope"), F.col(place).alias("place"),
        (F.col(role) if role else F.lit(None).cast("string")).alias("role"),
        F.split(F.translate(F.coalesce(F.col(text), F.lit("")), BREAK + LEVEL, ""), "\n").alias("lines"),
    )
    marks = F.transform(
        "lines",
        lambda x: F.when(
            F.ltrim(x).startswith(">"),
            F.length(F.translate(F.regexp_extract(x, QUOTE, 0), " \t", "")),
        ).otherwise(0),
    )
    leveled = lines.withColumn("levels", marks)
    joined = F.transform(
        "lines",
        lambda x, i: F.concat(
            F.when(
                (i > 0) & (F.get("levels", i) == F.get("levels", i - 1)), "\n"
            ).otherwise(F.concat(F.lit(BREAK), F.get("levels", i).cast("string"), F.lit(LEVEL))),
            F.when(F.get("levels", i) > 0, F.regexp_replace(x, QUOTE + " ?", "")).otherwise(x),
        ),
    )
    own = F.array_join(F.filter("lines", lambda x, i: F.get("levels", i) == 0), "\n")
    parts = leveled.select(
        "scope", "place", "role", own.alias("own"),
        F.split(F.substring(F.array_join(joined, ""), 2, 2**31 - 1), BREAK).alias("parts"),
    )
    passages = F.transform(
        "parts",
        lambda p: F.struct(
            F.substring_index(p, LEVEL, 1).cast("int").alias("level"),
            F.substring_index(p, LEVEL, -1).alias("text"),
        ),
    )
    return parts.select("scope", "place", "role", "own", passages.alias("passages"))


def _hashes(texts: Column) -> Column:
    """Distinct hashes of the texts that are not blank."""
    normal = F.filter(F.transform(F.array_distinct(texts), _normal), lambda x: x != "")
    return F.array_distinct(F.transform(normal, lambda x: F.unhex(F.md5(x))))


def hashed(messages: DataFrame) -> DataFrame:
    """scope, place, role and ``own`` of parsed rows, with the hashes ``said`` of own passages and those
    ``asked`` for, with their level, of quoted ones (part 0 is a whole passage, 1 a line)."""
    own = F.filter("passages", lambda p: p["level"] == 0)["text"]
    pieces = F.concat(
        F.array("own"), own,
        F.flatten(F.transform(own, lambda t: F.split(t, r"\n[ \t]*\n"))),
        F.split("own", "\n"),
    )
    quoted = F.filter("passages", lambda p: p["level"] > 0)

    def asked(p: Column) -> Column:
        told = lambda part: lambda h: F.struct(p["level"].alias("level"), F.lit(part).alias("part"), h.alias("hash"))
        return F.concat(
            F.transform(_hashes(F.array(p["text"])), told(0)),
            F.transform(_hashes(F.split(p["text"], "\n")), told(1)),
        )

    return messages.select(
        "scope", "place", "role", "own", _hashes(pieces).alias("said"),
        F.array_distinct(F.flatten(F.transform(quoted, asked))).alias("asked"),
    )


def replies(messages: DataFrame) -> DataFrame:
    """scope, place and ``parent``, the place of the message replied to, of those hashed rows that
    have one."""
    originals = (
        messages.select("scope", "place", F.explode("said").alias("hash"))
        .groupBy("scope", "hash").agg(F.min("place").alias("original"))
    )
    asked = messages.select("scope", "place", F.inline("asked"))
    # Scopes may be null; their text and a mark of null stand for them in the join.
    a = asked.withColumn("_spread", spread("scope", "hash"))
    b = originals.select(
        F.col("scope").alias("_scope"), F.col("hash").alias("_hash"), "original",
        spread("scope", "hash").alias("_other"),
    )
    found = a.join(
        b,
        (a["hash"] == b["_hash"]) & (a["_spread"] == b["_other"]) & a["scope"].eqNullSafe(b["_scope"]),
    ).filter(F.col("original") < F.col("place"))
    best = F.min(F.struct("level", "part", F.negative("original").alias("latest")))
    return found.groupBy("scope", "place").agg(best.alias("best")).select(
        "scope", "place", F.negative("best.latest").alias("parent")
    )


def starts(links: DataFrame) -> DataFrame:
    """scope, place, parent, ``start`` and ``depth``: the top of each reply's chain and how far up
    it is. Every round each row jumps to where its ancestor has got to, and rows that have reached their
    top are joined no more, so a row takes part as often as the logarithm of its depth; a round is
    written before the next."""
    going = written(
        links.select(
            "scope", "place", "parent", F.col("parent").alias("start"), F.lit(1).cast("long").alias("depth"),
            F.lit(False).alias("ended"),
        ),
        "ups",
    )
    ended: list[DataFrame] = []
    while True:
        higher = _union([going, *ended]).select(
            F.col("scope").alias("_scope"), F.col("place").alias("_place"), F.col("start").alias("higher"),
            F.col("depth").alias("more"), F.col("ended").alias("top"), spread("scope", "place").alias("_other"),
        )
        a = going.withColumn("_spread", spread("scope", "start"))
        jumped = a.join(
            higher,
            (a["start"] == higher["_place"]) & (a["_spread"] == higher["_other"])
            & a["scope"].eqNullSafe(higher["_scope"]),
            "left",
        ).select(
            "scope", "place", "parent", F.coalesce("higher", "start").alias("start"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.coalesce("top", F.lit(True)).alias("ended"),
        )
        jumped = written(jumped, "ups")
        ended.append(jumped.filter("ended"))
        going = jumped.filter("NOT ended")
        if going.isEmpty():
            return _union(ended).drop("ended")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def conversations(
    messages: DataFrame, scope: str = "conv_id", place: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row a message: scope, place, role, its text without quotes, ``parent``, ``start`` (the
    place of the first message of its conversation) and ``depth``. Sorted by scope, start and
    place, every reply comes after what it replies to."""
    rows = written(hashed(parsed(messages, scope, place, text, role)), "hashed")
    ups = starts(replies(rows)).select(
        F.col("scope").alias("_scope"), F.col("place").alias("_place"), "parent", "start", "depth",
        spread("scope", "place").alias("_other"),
    )
    a = rows.select("scope", "place", "role", "own", spread("scope", "place").alias("_spread"))
    out = a.join(
        ups,
        a["place"].eqNullSafe(ups["_place"]) & (a["_spread"] == ups["_other"]) & a["scope"].eqNullSafe(ups["_scope"]),
        "left",
    )
    return out.select(
        F.col("scope").alias(scope), F.col("place").alias(place), F.col("role").alias(role),
        F.col("own").alias(text), "parent", F.coalesce("start", "place").alias("start"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def as_mail(
    messages: DataFrame, scope: str = "conv_id", place: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Turns as mail: each quotes the whole turn before it below its own text, and the one before
    that a level deeper. For tables of turns, to which quotes are then what links them."""
    base = messages.select(F.col(scope), F.col(place), F.col(role), F.coalesce(F.col(text), F.lit("")).alias(text))
    before = base.groupBy(F.col(scope).alias("_s"), (F.col(place) + 1).alias("_p")).agg(F.min(text).alias("_before"))
    deeper = before.select(F.col("_s").alias("_t"), (F.col("_p") + 1).alias("_q"), F.col("_before").alias("_deeper"))
    quoted = lambda c, mark: F.concat(F.lit("\n" + mark), F.regexp_replace(c, "\n", "\n" + mark))
    return (
        base.join(before, base[scope].eqNullSafe(F.col("_s")) & (base[place] == F.col("_p")), "left")
        .join(deeper, base[scope].eqNullSafe(F.col("_t")) & (base[place] == F.col("_q")), "left")
        .select(
            scope, place, role,
            F.concat(
                F.col(text), F.coalesce(quoted(F.col("_before"), "> "), F.lit("")),
                F.coalesce(quoted(F.col("_deeper"), ">> "), F.lit("")),
            ).alias(text),
        )
    )
