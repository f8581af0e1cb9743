"""Quotation linking: conversations in reply order, without the quotes.

Lines that begin with ``>`` are quoted, at the level of how many they begin with. Runs of lines of one level, and single
quoted lines, are normalised (A-Z lower-cased, white space collapsed) and hashed; so are the bodies, paragraphs and lines
of what messages say themselves. The first message of a conversation that says a passage is its original. A message
replies to the original of its longest passage of the lowest level; threads are followed to their roots by jumping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import cut, enclosed, lower_ascii, opened, read

#: Separate runs, and a run's level from its text; taken out of texts first.
RUN, LEVEL = "\x1e", "\x1f"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(text), r"[\x20\x09-\x0D]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """``messages`` with body (the unquoted lines), n_quoted (quoted lines) and _runs ("level LEVEL text")."""
    lines = F.split(F.translate(F.coalesce("_text", F.lit("")), RUN + LEVEL, "  "), "\n")
    out = messages.withColumn("_lines", F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(?:[ \t]*>)*", 0).alias("mark"), x.alias("line"))))
    level = "length(regexp_replace(x.mark, '[^>]', ''))"
    out = out.withColumn("_lines", F.expr(f"transform(_lines, x -> struct({level} as level, if(x.mark = '', x.line, substring(x.line, length(x.mark) + 1)) as line))"))
    joined = f"transform(_lines, (x, i) -> concat(if(if(i = 0, true, _lines[i - 1].level <> x.level), concat('{RUN}', x.level, '{LEVEL}'), '\\n'), x.line))"
    out = out.withColumn("_runs", F.split(F.array_join(F.expr(joined), ""), RUN))
    out = out.withColumn("body", F.expr("array_join(transform(filter(_lines, x -> x.level = 0), x -> x.line), '\\n')"))
    return out.withColumn("n_quoted", F.expr("size(filter(_lines, x -> x.level > 0))").cast("long")).drop("_lines")


def hashed(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, key, size) of the normalised, not empty column _unit."""
    unit = df.withColumn("_unit", normal(F.col("_unit"))).where("_unit <> ''")
    return unit.select(*keep, F.md5(F.col("_unit").cast("binary")).alias("key"), F.length("_unit").alias("size"))


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with body, n_quoted, parent (the turn replied to, null if none is found), root, depth and thread.

    ``thread`` lists the turns from the root to the message; sorted by conversation and thread, a conversation is in reply
    order: each message before its replies, and these together. A null text has an empty body; a message of null
    conversation or turn links with nothing, and its root is its own turn. Of rows that repeat a turn each keeps its row
    and its own quotes; the turn's replies count once. Long texts are read whole; own columns of the new names, in any
    case, are replaced; an empty table stays empty.
    """
    step = parsed(enclosed(messages, _conv=conv, _turn=turn, _text=text))
    keyed = step.where("_conv is not null and _turn is not null").select(F.col("_conv").alias("_c"), F.col("_turn").cast("long").alias("_t"), "body", "_runs", "n_quoted")

    quoting = keyed.where("n_quoted > 0")
    runs = quoting.select("_c", "_t", F.explode("_runs").alias("_run")).where("_run <> ''").select("_c", "_t", F.substring_index("_run", LEVEL, 1).cast("int").alias("level"), F.expr(f"substring(_run, instr(_run, '{LEVEL}') + 1)").alias("_said")).where("level > 0")
    units = F.array_union(F.array("_said"), F.split("_said", "\n"))
    quoted = hashed(runs.select("_c", "_t", "level", F.explode(units).alias("_unit")), "_c", "_t", "level").distinct()

    says = keyed.join(quoting.select("_c").distinct(), "_c", "left_semi")
    units = F.array_union(F.array("body"), F.array_union(F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")))
    first = hashed(says.select("_c", "_t", F.explode(units).alias("_unit")), "_c", "_t").groupBy("_c", "key").agg(F.min("_t").alias("_from"))

    found = quoted.join(first, ["_c", "key"]).where("_from < _t")
    links = cut(found.groupBy("_c", "_t").agg(F.max_by("_from", F.struct(-F.col("level"), "size", "_from")).alias("_parent")))
    at = links.select("_c", "_t", "_parent", F.col("_parent").alias("_root"), F.lit(1).cast("long").alias("_depth"), F.array("_parent", "_t").alias("_path"))
    while True:  # roots, by jumping twice as far each time
        far = at.select("_c", F.col("_t").alias("_root"), F.col("_root").alias("_far"), F.col("_depth").alias("_more"), F.col("_path").alias("_before"))
        path = F.when(F.col("_far").isNull(), F.col("_path")).otherwise(F.concat("_before", F.slice("_path", 2, F.size("_path"))))
        at = cut(at.join(far, ["_c", "_root"], "left").select("_c", "_t", "_parent", F.coalesce("_far", "_root").alias("_root"), (F.col("_depth") + F.coalesce("_more", F.lit(0))).alias("_depth"), path.alias("_path"), F.col("_far").isNotNull().alias("_moved")))
        if at.where("_moved").isEmpty():
            break
        at = at.drop("_moved")
    held = at.select("_c", "_t", F.col("_parent").alias("parent"), "_root", "_depth", "_path")
    own = F.col("_turn").cast("long")
    out = step.join(held, (F.col("_conv") == F.col("_c")) & (own == F.col("_t")), "left")
    found = out.withColumns({"root": F.coalesce("_root", own), "depth": F.coalesce("_depth", F.lit(0)).cast("long"), "thread": F.coalesce("_path", F.array(own))})
    return opened(found, messages, ("body", "n_quoted", "parent", "root", "depth", "thread"), _conv=conv, _turn=turn, _text=text)


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The messages in reply order, ``text`` without the quotes; a sort over ranges, so that no conversation is gathered."""
    found = linked(messages, conv, turn, text)
    return found.withColumn(text, F.col("body")).sort(conv, "thread", turn).select(*messages.columns, *(c for c in ("parent", "depth", "thread") if c not in messages.columns))


def op4_quote_linking(spark, sf_dir: str) -> DataFrame:
    """Every message of ``conversations`` with its place in reply order (``thread``), and a digest of its body."""
    found = linked(read(spark, sf_dir, "conversations"))
    thread = F.array_join(F.col("thread").cast("array<string>"), "/")
    return found.select("conv_id", "turn", "role", "n_quoted", "parent", "root", "depth", thread.alias("thread"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


NORMAL = r"trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"
ORACLE = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, translate(coalesce(text, ''), chr(30) || chr(31), '  ') AS text FROM conversations),
lines AS (SELECT id, conv_id, turn, i, l, regexp_extract(l, '^(?:[ \t]*>)*') AS mark FROM (SELECT id, conv_id, turn, i, s[i] AS l FROM (SELECT id, conv_id, turn, string_split(text, chr(10)) AS s FROM m), unnest(range(1, len(s) + 1)) AS t(i))),
levels AS (SELECT *, len(regexp_replace(mark, '[^>]', '', 'g')) AS level, substr(l, len(mark) + 1) AS rest FROM lines),
steps AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY id ORDER BY i) THEN 0 ELSE 1 END AS new FROM levels),
islands AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM steps),
bodies AS (SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, coalesce(string_agg(rest, chr(10) ORDER BY i) FILTER (WHERE level = 0), '') AS body, count(*) FILTER (WHERE level > 0) AS n_quoted FROM levels GROUP BY id),
runs AS (SELECT id, any_value(conv_id) AS conv_id, any_value(turn) AS turn, any_value(level) AS level, string_agg(rest, chr(10) ORDER BY i) AS unit FROM islands WHERE level > 0 GROUP BY id, run),
quoted AS (SELECT DISTINCT conv_id, turn, level, {NORMAL.format("unit")} AS key FROM (SELECT conv_id, turn, level, unit FROM runs UNION ALL SELECT conv_id, turn, level, rest FROM levels WHERE level > 0)),
units AS (SELECT conv_id, turn, body AS unit FROM bodies UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(body, '\n[ \t]*\n')) FROM bodies UNION ALL SELECT conv_id, turn, unnest(string_split(body, chr(10))) FROM bodies),
first AS (SELECT conv_id, {NORMAL.format("unit")} AS key, min(turn) AS came FROM units GROUP BY ALL),
links AS (SELECT q.conv_id, q.turn, arg_max(came, (-level, len(key), came)) AS parent FROM quoted q JOIN first f USING (conv_id, key) WHERE came < q.turn AND key <> '' GROUP BY ALL),
chain AS (SELECT conv_id, turn, parent, parent AS root, 1 AS depth, [parent, turn] AS path FROM links
          UNION ALL SELECT c.conv_id, c.turn, c.parent, l.parent, depth + 1, list_prepend(l.parent, c.path) FROM chain c JOIN links l ON l.conv_id = c.conv_id AND l.turn = c.root),
roots AS (SELECT conv_id, turn, any_value(parent) AS parent, arg_max(root, depth) AS root, max(depth) AS depth, arg_max(path, depth) AS path FROM chain GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, m.role, CAST(n_quoted AS BIGINT) AS n_quoted, CAST(r.parent AS BIGINT) AS parent, CAST(coalesce(r.root, m.turn) AS BIGINT) AS root, CAST(coalesce(r.depth, 0) AS BIGINT) AS depth, array_to_string(coalesce(r.path, [m.turn]), '/') AS thread, sha256(body) AS body_sha256
FROM m JOIN bodies b USING (id) LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = m.turn
"""
