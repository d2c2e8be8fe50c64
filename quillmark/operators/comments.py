"""Comment blocks of source files, found with windows over lines; a file holds at most MAX_SOURCE characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.text import comment_syntax, script_language, shortened, trimmed

MAX_SOURCE = 400_000
FILE = ["repo", "path"]
#: Words that address a tool.
DIRECTIVES = (
    "shellcheck", "eslint-disable", "eslint-enable", "prettier-ignore", "biome-ignore", "stylelint-", "@ts-", "ts-ignore", "ts-expect-error",
    "istanbul ignore", "c8 ignore", "v8 ignore", "oxlint-disable", "deno-lint", "noinspection", "swiftlint", "codeql",
)
DIRECTIVE = rf"(?i)\A\s*({'|'.join(DIRECTIVES)})"


def source_lines(files: DataFrame) -> DataFrame:
    """repo, path, line_no (from 1), syntax, line (trimmed) of files (repo, path, source) that have a
    known comment syntax and aren't too large."""
    known = files.withColumn("syntax", comment_syntax(F.col("path"))).where(F.col("syntax").isNotNull() & (F.length("source") <= MAX_SOURCE))
    return known.select(*FILE, "syntax", F.posexplode(F.split("source", "\n", -1)).alias("at", "raw")).select(*FILE, "syntax", (F.col("at") + 1).alias("line_no"), trimmed(F.col("raw")).alias("line"))


def _unclosed(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, r"\*/\s*\z", ""))


def classified(lines: DataFrame) -> DataFrame:
    """Adds alone (what the line says as a comment on its own, null if it is none), is_doc, inside (a
    block comment opened above is still open) and said (the comment text in its place, null for code).

    A block comment is open where the last opening or closing line above opened one."""
    x, c = F.col("line"), F.col("syntax") == "c"
    begins = lambda s: F.startswith(x, F.lit(s))
    rest = lambda n: F.substring(x, n + 1, MAX_SOURCE)
    in_c = F.when(begins("/**"), _unclosed(rest(3))).when(begins("/*"), _unclosed(rest(2))).when(begins("*/"), "").when(begins("*"), trimmed(rest(1))).when(begins("//"), trimmed(rest(2)))
    in_lua = F.when(begins("---"), trimmed(rest(3))).when(begins("--"), trimmed(rest(2)))
    in_hash = F.when(begins("#") & ~begins("#!"), trimmed(F.regexp_replace(x, r"\A#+", "")))
    opens, closes = c & begins("/*") & ~F.contains(x, F.lit("*/")), c & F.contains(x, F.lit("*/"))
    above = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns({
        "alone": F.when(c, in_c).when(F.col("syntax") == "lua", in_lua).otherwise(in_hash),
        "is_doc": F.when(c, begins("/**")).when(F.col("syntax") == "lua", begins("---")).otherwise(F.lit(False)),
        "inside": F.coalesce(F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(above), F.lit(False)),
    })
    continued = trimmed(F.regexp_replace(F.regexp_replace(x, r"\*/\s*\z", ""), r"\A\*+", ""))
    return marked.withColumn("said", F.when(F.col("inside"), continued).otherwise(F.col("alone")))


def code_below(reach: int = 4) -> Column:
    """The first line with something on it among the next few: null if that is a comment itself."""
    at = Window.partitionBy(*FILE).orderBy("line_no")
    ahead = [F.lead(F.struct("line", "alone"), k).over(at) for k in range(1, reach + 1)]
    first = F.coalesce(*[F.when(a["line"] != "", a) for a in ahead])
    return F.when(first["alone"].isNull(), first["line"])


def comment_blocks(files: DataFrame) -> DataFrame:
    """repo, path, start_line, lines, line_nos, text, is_doc, lang, code: runs of comment lines.

    Empty lines at a block's ends are dropped and its line numbers are those of the lines that stay.
    Files without comments give none."""
    at = Window.partitionBy(*FILE).orderBy("line_no")
    rows = classified(source_lines(files)).withColumn("below", code_below())
    runs = rows.withColumn("run", F.sum(F.when(F.col("said").isNull(), 1).otherwise(0)).over(at.rowsBetween(Window.unboundedPreceding, 0))).where("said is not null")
    inside_first = F.min_by(F.col("is_doc") & ~F.col("inside"), "line_no")
    blocks = runs.groupBy(*FILE, "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "said"))).alias("all"), inside_first.alias("is_doc"), F.max_by("below", "line_no").alias("code"))
    spoken = F.transform(F.filter("all", lambda e: e["said"] != ""), lambda e: e["line_no"])
    cut = blocks.where(F.size(spoken) > 0).withColumn("all", F.filter("all", lambda e: e["line_no"].between(F.array_min(spoken), F.array_max(spoken))))
    lines = F.transform("all", lambda e: e["said"])
    return cut.select(
        *FILE,
        F.col("all")[0]["line_no"].alias("start_line"),
        lines.alias("lines"),
        F.transform("all", lambda e: e["line_no"]).alias("line_nos"),
        F.array_join(lines, "\n").alias("text"),
        "is_doc",
        script_language(F.array_join(lines, " ")).alias("lang"),
        shortened(F.col("code"), 160).alias("code"),
    )


def is_prose(lines: Column) -> Column:
    """Words rather than syntax or a tool's directives."""
    text = F.array_join(lines, " ")
    directives = F.forall(lines, lambda x: (F.trim(x) == "") | x.rlike(DIRECTIVE))
    return ~directives & (F.regexp_count(text, F.lit(r"\p{L}")) >= 4) & (F.regexp_count(text, F.lit(r"[{}();=<>\[\]]")) / F.greatest(F.length(text), F.lit(1)) < 0.08)


def owned(blocks: DataFrame, blame: DataFrame, emails: list[str]) -> DataFrame:
    """Blocks of which the owner wrote more than half the blamed lines, with the year of their last.

    blame: repo, path, line_no, email, year. Lines without blame don't vote."""
    mine = F.col("email").isin([e.lower() for e in emails])
    votes = blocks.select(*FILE, "start_line", F.explode("line_nos").alias("line_no")).join(blame, [*FILE, "line_no"])
    won = votes.groupBy(*FILE, "start_line").agg(F.avg(F.when(mine, 1.0).otherwise(0.0)).alias("share"), F.max(F.when(mine, F.col("year"))).alias("year")).where("share > 0.5")
    return blocks.join(won.drop("share"), [*FILE, "start_line"])


def comment_corpus(files: DataFrame, blame: DataFrame, emails: list[str]) -> DataFrame:
    """The owner's prose blocks."""
    return owned(comment_blocks(files).where(is_prose(F.col("lines"))), blame, emails)


def comment_turns(comments: DataFrame, longform_min_chars: int = 300) -> DataFrame:
    """Blocks as turns: the code below is the context, repositories are pseudonyms, there is no time."""
    from quillmark.functions.text import pseudonym, utf16_len

    chars = utf16_len(F.col("text"))
    return comments.select(
        pseudonym("repo", F.col("repo")).alias("chat_key"),
        F.when(F.col("is_doc"), "jsdoc").otherwise("code").alias("register"),
        (chars >= longform_min_chars).alias("longform"),
        "lang",
        F.lit(0).cast("long").alias("ts"),
        "year",
        F.col("lines").alias("parts"),
        "text",
        F.size("lines").alias("n_parts"),
        chars.alias("chars"),
        F.col("code").alias("context_in"),
        F.lit(False).alias("context_explicit"),
        F.lit(None).cast("long").alias("context_lag"),
    )
