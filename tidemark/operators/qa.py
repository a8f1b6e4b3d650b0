"""Monthly question and completion tests: build, filter, ask, score.

Text written by a model enters as a table (response, verdict, answer), keyed like the
row it belongs to.  Each stage is a DataFrame in and a DataFrame out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed, prompts, scoring, text
from tidemark.operators.prefix import hash_bucket, ordinal_bucket, running_total

KEYS = ["dataset", "month"]
QA_LIST = "array<struct<question:string,answer:string>>"


# --- build ------------------------------------------------------------------
def parse_qa(response: Column) -> Column:
    """QA pairs from model text, read as JSON and never evaluated; NULL when it is none."""
    return F.from_json(response, QA_LIST)


def until_n_successes(
    attempts: DataFrame, keys: list[str], order: list[str], ok: Column, n: int, bucket: Column,
) -> DataFrame:
    """Attempts, failed ones too, up to and with the n-th success of each key."""
    counted = running_total(attempts, keys, order, ok.cast("int"), bucket, out="successes", limit=n - 1)
    return counted.where(F.col("successes") < n)


def attempts(
    articles: DataFrame, responses: DataFrame, prompt: Column, n: int = fixed.QUIZ_EXAMPLES,
    seed: int = fixed.SHUFFLE_SEED,
) -> DataFrame:
    """Articles of a month in seeded order with prompt and parsed response, until n parse.

    Where to stop follows from the responses alone, each of which belongs to an
    article.  Articles come in last, so only the texts of the few that are kept move.
    """
    parsed = responses.select(
        *KEYS, "doc_ord", text.seeded_hash(F.col("doc_ord"), seed).alias("shuffle_key"),
        parse_qa(F.col("response_text")).alias("response"),
    )
    kept = until_n_successes(
        parsed, KEYS, ["shuffle_key", "doc_ord"], F.col("response").isNotNull(), n, hash_bucket("shuffle_key")
    )
    return articles.join(kept, [*KEYS, "doc_ord"]).withColumn("prompt", prompt)


def dated(question: Column, published: Column) -> Column:
    """'{Mon YYYY}: {question}'."""
    return F.concat(F.date_format(F.to_date(published), "MMM yyyy"), F.lit(": "), question)


def flatten_pairs(attempted: DataFrame, published: str | None = "published_date") -> DataFrame:
    """One row per QA pair; pairs without a question are skipped.

    Questions get the date of the article in front.  Without a date column, as for
    knowledge questions, they stay as they are.
    """
    rows = attempted.select(
        *KEYS, "doc_ord", *([published] if published else []), F.posexplode("response").alias("qa_ord", "qa")
    )
    asked = F.col("qa.question")
    return rows.where(asked.isNotNull()).select(
        *KEYS, "doc_ord", "qa_ord",
        (dated(asked, F.col(published)) if published else asked).alias("question"),
        F.col("qa.answer").alias("answer"),
    )


def code_lines(examples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Completion examples whose last line is code by its verdict, with the `prompt` that asked for it."""
    kept = keep_confirmed(examples, verdicts, [*KEYS, "doc_ord"])
    return kept.withColumn("prompt", prompts.code_line(F.col("last_line")))


def keep_confirmed(rows: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose verdict text says yes."""
    yes = verdicts.where(scoring.verdict(F.col("verdict_text")) == F.lit(True))
    return rows.join(yes.select(*keys), keys, "left_semi")


def requestion(question: Column) -> Column:
    """'{date}: {q}' -> 'In {date}, {q}'; NULL unless it splits into exactly two parts."""
    parts = F.split(question, ": ")
    return F.when(F.size(parts) == 2, F.concat(F.lit("In "), parts[0], F.lit(", "), parts[1]))


def questions(kept: DataFrame, model: str, with_date: bool = True) -> DataFrame:
    """The question table for a model, with its prompt."""
    asked = kept
    if with_date:
        asked = kept.withColumn("question", requestion(F.col("question"))).where(F.col("question").isNotNull())
    return asked.withColumn("prompt", prompts.answer(F.lit(model), F.col("question")))


def zip_tables(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Parallel lists as tables with an explicit index: rows that share it belong together."""
    return reduce(lambda a, b: a.join(b, keys), tables)


# --- score ------------------------------------------------------------------
def score_answers(answers: DataFrame, marker: str = "\nQuestion") -> DataFrame:
    """Substring and judge accuracy per example; answers end at the marker for the judge."""
    return answers.withColumns({
        "accuracy": scoring.substring_accuracy(F.col("out"), F.col("ref_answer")),
        "judged": F.transform("out", lambda o: text.before(o, marker)),
        "llm_acc": scoring.judge_accuracy(F.col("judges")),
    })


def judge_prompts(
    answers: DataFrame, keys: list[str], prompt: Callable[[Column], Column], marker: str = "\nQuestion",
) -> DataFrame:
    """One row per (example, candidate) with the prompt a judge gets; `prompt` sees the cut candidate."""
    carried = [c for c in answers.columns if c not in (*keys, "out")]
    rows = answers.select(*keys, *carried, F.posexplode("out").alias("o", "candidate"))
    return rows.select(*keys, "o", prompt(text.before(F.col("candidate"), marker)).alias("prompt"))


def collect_judges(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Judge texts of an example as one array in candidate order; there is one per candidate."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("o", "judge"))), lambda j: j["judge"])
    return judged.groupBy(*keys).agg(texts.alias("judges"))


def monthly_accuracy(scored: DataFrame) -> DataFrame:
    return scored.groupBy("month").agg(
        F.count("*").alias("n_examples"),
        F.avg("accuracy").alias("accuracy"),
        F.avg("llm_acc").alias("llm_acc"),
    )


def batch_requests(answers: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """One request per (example, candidate); examples are numbered within their month."""
    numbered = running_total(answers, ["month"], order, F.lit(1), bucket, out="e")
    rows = numbered.select(
        "month", "e", "question", "ref_answer", F.posexplode("out").alias("o", "candidate")
    )
    prompt = prompts.batch_judge(
        F.col("question"), F.col("ref_answer"), text.before(F.col("candidate"), "\nQuestion")
    )
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    return rows.select(
        F.concat_ws("-", "month", "e", "o").alias("custom_id"),
        F.lit(fixed.BATCH_METHOD).alias("method"),
        F.lit(fixed.BATCH_URL).alias("url"),
        F.struct(
            F.lit(fixed.BATCH_MODEL).alias("model"),
            F.array(message).alias("messages"),
            F.lit(fixed.BATCH_MAX_TOKENS).alias("max_tokens"),
        ).alias("body"),
    )


# --- code completion --------------------------------------------------------
def completion_blocks(
    files: DataFrame, block: int = fixed.BLOCK_LINES, minimum: int = fixed.BLOCK_MIN_LINES,
    reserve: int = fixed.BLOCK_RESERVE, seed: int = fixed.SHUFFLE_SEED,
) -> DataFrame:
    """A repeatable run of `block` lines from files with enough lines that are not blank."""
    lines = files.withColumn("_lines", text.filled_lines(F.col("text"))).where(F.size("_lines") >= minimum)
    start = text.seeded_start(F.col("doc_ord"), seed, F.size("_lines") - reserve)
    return lines.withColumn("block", F.slice("_lines", start + 1, F.lit(block))).drop("_lines", "text")


def last_long_line(blocks: DataFrame, more_than: int = fixed.TARGET_MIN_TOKENS) -> DataFrame:
    """The last line with more than so many tokens, and the lines before it.

    Blocks without such a line are dropped.  A block is a hundred lines, so all of
    this stays inside the row.
    """
    sized = blocks.withColumn("_sizes", F.transform("block", lambda line: F.size(text.words(line))))
    at = F.array_max(F.filter(
        F.transform("_sizes", lambda n, i: F.when(n > more_than, i)), lambda i: i.isNotNull()
    ))
    found = sized.withColumn("_at", at).where(F.col("_at").isNotNull())
    return found.select(
        *[c for c in blocks.columns if c != "block"],
        F.element_at("block", F.col("_at") + 1).alias("last_line"),
        F.slice("block", 1, F.col("_at")).alias("context"),
        F.slice("_sizes", 1, F.col("_at")).alias("sizes"),
    )


def suffix_budget(examples: DataFrame, budget: int = fixed.PROMPT_TOKEN_BUDGET) -> DataFrame:
    """Longest run of context lines at the end that fits the budget; all lines if none fits."""
    n = F.size("sizes")
    fits = F.size(F.filter(
        F.transform("sizes", lambda s, i: F.aggregate(
            F.slice("sizes", i + 1, n - i), F.lit(0), lambda a, v: a + v
        )),
        lambda rest: rest <= budget,
    ))
    counted = examples.withColumn("n_fit", fits)
    kept = F.when(F.col("n_fit") == 0, F.col("context")).otherwise(
        F.slice("context", n - F.col("n_fit") + 1, F.col("n_fit"))
    )
    return counted.withColumn("code", F.array_join(kept, "\n")).drop("context", "sizes")


def hint_split(examples: DataFrame, hint: int = fixed.HINT_TOKENS) -> DataFrame:
    """First tokens of the target line as a hint, the rest as the target."""
    toks = text.words(F.col("last_line"))
    return examples.withColumns({
        "prompting_tokens": F.array_join(F.slice(toks, 1, hint), " "),
        "left_tokens": F.array_join(F.slice(toks, hint + 1, F.size(toks)), " "),
    })


def completion_examples(
    files: DataFrame, n: int = fixed.CODE_EXAMPLES, block: int = fixed.BLOCK_LINES,
    minimum: int = fixed.BLOCK_MIN_LINES, reserve: int = fixed.BLOCK_RESERVE,
    budget: int = fixed.PROMPT_TOKEN_BUDGET, seed: int = fixed.SHUFFLE_SEED,
) -> DataFrame:
    """The first n examples of each month, files in seeded order; failures are not stored."""
    made = hint_split(suffix_budget(last_long_line(completion_blocks(files, block, minimum, reserve, seed)), budget))
    keyed = made.withColumn("shuffle_key", text.seeded_hash(F.col("doc_ord"), seed))
    return until_n_successes(
        keyed, KEYS, ["shuffle_key", "doc_ord"], F.lit(1), n, hash_bucket("shuffle_key")
    ).drop("successes")


def score_completions(answers: DataFrame) -> DataFrame:
    """First line of each candidate, its edit-distance score and the judge accuracy."""
    cut = answers.withColumn("out", F.transform("out", lambda o: text.before(o, "\n")))
    return cut.withColumns({
        "auto_acc": scoring.edit_distance_score(F.col("out"), F.col("left_tokens")),
        "llm_acc": scoring.judge_accuracy(F.col("judges")),
    })
