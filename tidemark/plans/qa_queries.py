"""Question and completion tests: build, filter, ask, score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed, prompts, scoring, text
from tidemark.operators import qa
from tidemark.operators.prefix import hash_bucket, ordinal_bucket
from tidemark.plans import sqltext as q
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources import conversations, corpus, quiz, stages

KEYS = ["dataset", "month"]
# Successes after which attempts stop, in the queries of that operator.
EXAMPLES = 3
ASK_MODEL = "meta-llama/Llama-2-7b-chat-hf"
JUDGE_MODEL = "meta-llama/Meta-Llama-3-8B-Instruct"

# --- SQL of the stand-in inputs ----------------------------------------------
SQL_PAIR = (
    "{{'question': (CASE WHEN doc_ord % 7 = {i} THEN 'Which: ' ELSE '' END) || 'What follows {i} ' || "
    "regexp_extract(text, '([A-Za-z]+)', 1) || '?', 'answer': coalesce((" + q.SENTENCES.replace("{", "{{").replace("}", "}}") + ")[1], '')}}"
)
RESPONSES = f"""{q.CORPUS},
art AS (
  SELECT *, month || '-' || lpad((doc_ord % 28 + 1)::VARCHAR, 2, '0') AS published_date,
         array_to_string(string_split(text, ' ')[1:3], ' ') AS title, split_part(text, '.', 1) AS description,
         {q.seeded_hash('doc_ord')} AS shuffle_key,
         CASE WHEN doc_ord % 3 <> 0 THEN [{SQL_PAIR.format(i=0)}, {SQL_PAIR.format(i=1)}] END AS response FROM corpus),
att AS (
  SELECT *, coalesce(sum((response IS NOT NULL)::INTEGER) OVER (
           PARTITION BY dataset, month ORDER BY shuffle_key, doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS successes
  FROM art QUALIFY successes < {EXAMPLES}),
flat AS (
  SELECT dataset, month, doc_ord, published_date, text, unnest(response) AS r, generate_subscripts(response, 1) - 1 AS qa_ord
  FROM art),
pairs AS (
  SELECT dataset, month, doc_ord, qa_ord::INTEGER AS qa_ord, text,
         strftime(published_date::DATE, '%b %Y') || ': ' || r.question AS question, r.answer AS answer FROM flat),
verd AS (
  SELECT *, CASE (doc_ord + qa_ord) % 5 WHEN 0 THEN 'No, it is not.' WHEN 1 THEN 'Not sure' WHEN 2 THEN text
            ELSE 'Yes' END AS verdict_text FROM pairs),
kept AS (SELECT * EXCLUDE (verdict_text, text) FROM verd WHERE contains(lower(verdict_text), 'yes'))"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.articles(spark, sf_dir)


def attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = prompts.news_question(
        F.col("title"), F.col("published_date"), F.col("description"), F.col("content")
    )
    return qa.attempts(articles(spark, sf_dir), quiz.responses(spark, sf_dir), prompt, EXAMPLES)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of every response that parses."""
    answered = quiz.responses(spark, sf_dir).withColumn("response", qa.parse_qa(F.col("response_text")))
    return qa.flatten_pairs(articles(spark, sf_dir).join(answered, [*KEYS, "doc_ord"]))


def confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.keep_confirmed(pairs(spark, sf_dir), quiz.verdicts(spark, sf_dir), [*KEYS, "doc_ord", "qa_ord"])


# --- build ------------------------------------------------------------------
@query("render_prompts", f"""WITH {RESPONSES}
SELECT doc_ord, md5({q.render(fixed.NEWS_QUESTION_PROMPT, title='title', published_date='published_date', description='description', content='text')}) AS news,
       md5({q.render(fixed.WIKI_QUESTION_PROMPT, title='title', content="array_to_string((" + q.words('substr(text, 1, 500)') + ")[1:50], ' ')")}) AS wiki,
       {q.render(fixed.ANSWERABLE_PROMPT, question='title')} AS answerable,
       {q.render(fixed.ANSWER_PROMPTS[ASK_MODEL], question='title')} AS answer,
       md5({q.render(fixed.FACT_JUDGE_PROMPTS[JUDGE_MODEL], question='title', ref_answer='month', out='description')}) AS judge,
       md5({q.render(fixed.CODE_LINE_PROMPT, last_line='title')}) AS code_line FROM (
  SELECT doc_ord, text, month, published_date, description, trim(title, ' ' || chr(9) || chr(10) || chr(13)) AS title FROM art)""")
def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).withColumn("title", text.strip(F.col("title")))
    title = F.col("title")
    cut = F.array_join(text.cut_text(F.col("content"), 50), " ")
    return rows.select(
        "doc_ord",
        F.md5(prompts.news_question(title, F.col("published_date"), F.col("description"), F.col("content"))).alias("news"),
        F.md5(prompts.wiki_question(title, cut)).alias("wiki"),
        prompts.answerable(title).alias("answerable"),
        prompts.answer(F.lit(ASK_MODEL), title).alias("answer"),
        F.md5(prompts.judge(F.lit(JUDGE_MODEL), title, F.col("month"), F.col("description"))).alias("judge"),
        F.md5(prompts.code_line(title)).alias("code_line"),
    )


@query("parse_qa", f"""WITH {RESPONSES}
SELECT doc_ord, response IS NOT NULL AS parsed, len(response)::INTEGER AS n_pairs, response[1].question AS first_question,
       response[2].answer AS last_answer FROM art""")
def parse_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = quiz.responses(spark, sf_dir).withColumn("response", qa.parse_qa(F.col("response_text")))
    return parsed.select(
        "doc_ord", F.col("response").isNotNull().alias("parsed"),
        F.when(F.col("response").isNotNull(), F.size("response")).alias("n_pairs"),
        F.col("response")[0]["question"].alias("first_question"), F.col("response")[1]["answer"].alias("last_answer"),
    )


@query("qa_attempts", f"""WITH {RESPONSES}
SELECT dataset, month, doc_ord, successes, response IS NOT NULL AS parsed, len(response)::INTEGER AS n_pairs,
       md5({q.render(fixed.NEWS_QUESTION_PROMPT, title='title', published_date='published_date', description='description', content='text')}) AS prompt
FROM att""")
def qa_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempted(spark, sf_dir).select(
        *KEYS, "doc_ord", "successes", F.col("response").isNotNull().alias("parsed"),
        F.when(F.col("response").isNotNull(), F.size("response")).alias("n_pairs"), F.md5("prompt").alias("prompt"),
    )


@query("until_n_successes", f"""WITH {q.CORPUS},
s AS (SELECT *, length(text) % 2 = 0 AS ok FROM corpus),
r AS (SELECT *, coalesce(sum(ok::INTEGER) OVER (PARTITION BY dataset, month ORDER BY doc_ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT dataset, month, count(*) AS n_attempts, count(*) FILTER (ok) AS n_ok, max(doc_ord) AS last_doc
FROM r WHERE before < {EXAMPLES} GROUP BY ALL""")
def until_n_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir).withColumn("ok", F.length("text") % 2 == 0).drop("text")
    kept = qa.until_n_successes(docs, KEYS, ["doc_ord"], F.col("ok"), EXAMPLES, ordinal_bucket())
    return kept.groupBy(*KEYS).agg(
        F.count("*").alias("n_attempts"), F.count_if("ok").alias("n_ok"), F.max("doc_ord").alias("last_doc")
    )


@query("date_questions", f"""WITH {RESPONSES} SELECT dataset, month, doc_ord, qa_ord, question, answer FROM pairs""")
def date_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query("parse_verdict", f"""SELECT conv_id, turn, {q.verdict('text')} AS verdict,
       CASE WHEN regexp_matches(lower(text), {q.literal(scoring.WHOLE_WORD.format('yes'))}) THEN true
            WHEN regexp_matches(lower(text), {q.literal(scoring.WHOLE_WORD.format('no'))}) THEN false END AS strict
FROM conversations""")
def parse_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return said.select(
        "conv_id", "turn", scoring.verdict(F.col("text")).alias("verdict"),
        scoring.verdict(F.col("text"), whole_words=True).alias("strict"),
    )


@query("qa_answerable", f"""WITH {RESPONSES} SELECT dataset, month, doc_ord, qa_ord, question, answer FROM kept""")
def qa_answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confirmed(spark, sf_dir)


@query("requestion", f"""WITH {RESPONSES}
SELECT dataset, month, doc_ord, qa_ord, CASE WHEN len(string_split(question, ': ')) = 2
  THEN 'In ' || string_split(question, ': ')[1] || ', ' || string_split(question, ': ')[2] END AS question FROM pairs""")
def requestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(*KEYS, "doc_ord", "qa_ord", qa.requestion(F.col("question")).alias("question"))


@query("qa_questions", f"""WITH {RESPONSES},
asked AS (SELECT * REPLACE ('In ' || string_split(question, ': ')[1] || ', ' || string_split(question, ': ')[2] AS question)
          FROM kept WHERE len(string_split(question, ': ')) = 2)
SELECT dataset, month, doc_ord, qa_ord, question, answer, {q.render(fixed.ANSWER_PROMPTS[ASK_MODEL], question='question')} AS prompt
FROM asked""")
def qa_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.questions(confirmed(spark, sf_dir), ASK_MODEL)


# --- score ------------------------------------------------------------------
@query("qa_zip", f"""WITH {q.ANSWERS}
SELECT month, conv_id, idx, question, ref_answer, len(out)::INTEGER AS n_out, md5(array_to_string(out, '|')) AS digest
FROM answers""")
def qa_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.answers(spark, sf_dir)
    return rows.select(
        "month", "conv_id", "idx", "question", "ref_answer", F.size("out").alias("n_out"),
        F.md5(F.array_join("out", "|")).alias("digest"),
    )


ACCURACY = "list_avg(list_transform(out, lambda o: contains(lower(o), lower(ref_answer))::INTEGER))"
JUDGED = f"list_avg(list_transform(judges, lambda j: ({q.verdict('j')})::INTEGER))"


@query("substring_accuracy", f"""WITH {q.ANSWERS}
SELECT conv_id, idx, round({ACCURACY}, 8) AS accuracy FROM answers""")
def substring_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.answers(spark, sf_dir)
    score = scoring.substring_accuracy(F.col("out"), F.col("ref_answer"))
    return rows.select("conv_id", "idx", F.round(score, 8).alias("accuracy"))


@query("judge_accuracy", f"""WITH {q.ANSWERS} SELECT conv_id, idx, round({JUDGED}, 8) AS llm_acc FROM answers""")
def judge_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.answers(spark, sf_dir)
    return rows.select("conv_id", "idx", F.round(scoring.judge_accuracy(F.col("judges")), 8).alias("llm_acc"))


# The SQL engine counts edits in bytes.  Mapping each accented letter of the texts to one
# byte of its own makes bytes and characters the same.
ACCENTS = "éèêçàüöäßñíóáúÉÈÊÇÍÑÓÜÖÄ"
TO_BYTES = f"translate({{}}, '{ACCENTS}', {' || '.join(f'chr({i})' for i in [*range(1, 9), *range(14, 30)])})"
STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def sql_edit_score(outs: str, ref: str) -> str:
    def clean(x: str) -> str:
        return TO_BYTES.format(f"lower({STRIP.format(x)})")

    mean = f"list_avg(list_transform({outs}, lambda o: levenshtein({clean(ref)}, {clean('o')})))"
    return f"CASE WHEN length({ref}) > 0 THEN (length({ref}) - {mean}) / length({ref}) END"


@query("edit_distance_score", f"""WITH {q.ANSWERS}
SELECT conv_id, idx, round({sql_edit_score('out', 'question')}, 8) AS score FROM answers""")
def edit_distance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.answers(spark, sf_dir)
    score = scoring.edit_distance_score(F.col("out"), F.col("question"))
    return rows.select("conv_id", "idx", F.round(score, 8).alias("score"))


@query("truncate_marker", """SELECT doc_id AS doc_ord, md5(string_split(text, '. ')[1]) AS before_stop,
       md5(string_split(text, chr(10))[1]) AS first_line FROM documents""")
def truncate_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    return docs.select(
        "doc_ord", F.md5(text.before(F.col("text"), ". ")).alias("before_stop"),
        F.md5(text.before(F.col("text"), "\n")).alias("first_line"),
    )


SCORES = f"""{q.ANSWERS},
scores AS (SELECT month, conv_id, idx, {ACCURACY} AS accuracy, {JUDGED} AS llm_acc FROM answers)"""


@query("qa_scores", f"""WITH {SCORES}
SELECT month, conv_id, idx, round(accuracy, 8) AS accuracy, round(llm_acc, 8) AS llm_acc FROM scores""")
def qa_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = qa.score_answers(conversations.answers(spark, sf_dir))
    return scored.select(
        "month", "conv_id", "idx", F.round("accuracy", 8).alias("accuracy"), F.round("llm_acc", 8).alias("llm_acc")
    )


@query("qa_monthly", f"""WITH {SCORES}
SELECT month, count(*) AS n_examples, round(avg(accuracy), 8) AS accuracy, round(avg(llm_acc), 8) AS llm_acc
FROM scores GROUP BY ALL""")
def qa_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = qa.monthly_accuracy(qa.score_answers(conversations.answers(spark, sf_dir)))
    return monthly.withColumns({n: F.round(n, 8) for n in ("accuracy", "llm_acc")})


@query("batch_requests", f"""WITH {q.ANSWERS},
num AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY conv_id, idx) - 1 AS e FROM answers),
rq AS (SELECT month, e, question, ref_answer, unnest(out) AS o, generate_subscripts(out, 1) - 1 AS i FROM num)
SELECT month || '-' || e || '-' || i AS custom_id, '{fixed.BATCH_METHOD}' AS method, '{fixed.BATCH_URL}' AS url,
       '{fixed.BATCH_MODEL}' AS model, {fixed.BATCH_MAX_TOKENS} AS max_tokens, 'user' AS role,
       {q.render(fixed.BATCH_JUDGE_PROMPT, question='question', ref_answer='ref_answer', out="string_split(o, chr(10) || 'Question')[1]")} AS content
FROM rq""")
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests go out as JSON lines and are read back."""
    requests = qa.batch_requests(
        conversations.answers(spark, sf_dir), ["conv_id", "idx"], ordinal_bucket("conv_id")
    )
    path = shared_folder(spark, "requests")
    stages.request_file(requests, path)
    lines = spark.read.schema(requests.schema).json(path)
    return lines.select(
        "custom_id", "method", "url", F.col("body.model").alias("model"), F.col("body.max_tokens").alias("max_tokens"),
        F.col("body.messages")[0]["role"].alias("role"), F.col("body.messages")[0]["content"].alias("content"),
    )


@query("todo_antijoin", f"""WITH {q.CORPUS}
SELECT dataset, month, doc_ord FROM corpus WHERE doc_ord NOT IN (SELECT doc_id FROM labels)""")
def todo_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("doc_ord"))
    wanted = corpus.documents(spark, sf_dir).drop("text")
    return stages.todo(wanted, done, ["doc_ord"]).select(*KEYS, "doc_ord")


@query("stage_roundtrip", f"""WITH {RESPONSES} SELECT dataset, month, doc_ord, qa_ord, question, answer FROM kept""")
def stage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages written and read; rewriting one month leaves the others alone."""
    root = shared_folder(spark, "stages")
    stages.write_stage(pairs(spark, sf_dir), root, "questions")
    kept = qa.keep_confirmed(stages.read_stage(spark, root, "questions"), quiz.verdicts(spark, sf_dir), [*KEYS, "doc_ord", "qa_ord"])
    stages.write_stage(kept, root, "filtered")
    last = kept.agg(F.max("month")).scalar()
    stages.write_stage(kept.where(F.col("month") == last), root, "filtered")
    return stages.read_stage(spark, root, "filtered").select(*KEYS, "doc_ord", "qa_ord", "question", "answer")


# --- code completion --------------------------------------------------------
BLOCK, MINIMUM, RESERVE, BUDGET = 15, 20, 17, 60

COMPLETION = f"""{q.CORPUS},
ln AS (SELECT dataset, month, doc_ord, text, list_filter(string_split(text, chr(10)), lambda s: {STRIP.format('s')} <> '') AS l FROM corpus),
st AS (SELECT *, {q.seeded_start('doc_ord', f'len(l) - {RESERVE}')} AS s FROM ln WHERE len(l) >= {MINIMUM}),
bl AS (SELECT dataset, month, doc_ord, l[s + 1:s + {BLOCK}] AS block FROM st),
sz AS (SELECT *, list_transform(block, lambda x: len({q.words('x')})) AS sizes FROM bl),
lastp AS (SELECT *, list_max(list_filter(range(1, len(block) + 1), lambda i: sizes[i] > {fixed.TARGET_MIN_TOKENS})) AS p FROM sz),
ex AS (SELECT dataset, month, doc_ord, block[p] AS last_line, block[1:p - 1] AS context, sizes[1:p - 1] AS sizes FROM lastp WHERE p IS NOT NULL),
fit AS (SELECT *, len(list_filter(range(1, len(sizes) + 1), lambda i: list_sum(sizes[i:]) <= {BUDGET}))::INTEGER AS n_fit FROM ex),
made AS (
  SELECT dataset, month, doc_ord, last_line, n_fit,
         array_to_string(CASE WHEN n_fit = 0 THEN context ELSE context[len(context) - n_fit + 1:] END, chr(10)) AS code,
         array_to_string(({q.words('last_line')})[1:3], ' ') AS prompting_tokens,
         array_to_string(({q.words('last_line')})[4:], ' ') AS left_tokens FROM fit)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.completion_blocks(corpus.documents(spark, sf_dir), BLOCK, MINIMUM, RESERVE)


@query("last_long_line", f"""WITH {COMPLETION}
SELECT doc_ord, last_line, len(context)::INTEGER AS n_before FROM ex""")
def last_long_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qa.last_long_line(blocks(spark, sf_dir))
    return found.select("doc_ord", "last_line", F.size("context").alias("n_before"))


@query("suffix_budget", f"""WITH {COMPLETION} SELECT doc_ord, n_fit, md5(code) AS digest FROM made""")
def suffix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = qa.suffix_budget(qa.last_long_line(blocks(spark, sf_dir)), BUDGET)
    return cut.select("doc_ord", "n_fit", F.md5("code").alias("digest"))


@query("hint_split", f"""WITH {COMPLETION} SELECT doc_ord, prompting_tokens, left_tokens FROM made""")
def hint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = qa.hint_split(qa.last_long_line(blocks(spark, sf_dir)))
    return split.select("doc_ord", "prompting_tokens", "left_tokens")


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.completion_examples(corpus.documents(spark, sf_dir), fixed.CODE_EXAMPLES, BLOCK, MINIMUM, RESERVE, BUDGET)


TAKEN = f"""{COMPLETION},
taken AS (SELECT * FROM made QUALIFY row_number() OVER (
  PARTITION BY dataset, month ORDER BY {q.seeded_hash('doc_ord')}, doc_ord) <= {fixed.CODE_EXAMPLES})"""


@query("completion_examples", f"""WITH {TAKEN}
SELECT dataset, month, doc_ord, last_line, md5(code) AS digest, prompting_tokens, left_tokens FROM taken""")
def completion_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return completions(spark, sf_dir).select(
        *KEYS, "doc_ord", "last_line", F.md5("code").alias("digest"), "prompting_tokens", "left_tokens"
    )


@query("code_lines", f"""WITH {TAKEN},
v AS (SELECT *, CASE doc_ord % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No, it is a comment.' ELSE code END AS verdict_text FROM taken)
SELECT dataset, month, doc_ord, last_line, {q.render(fixed.CODE_LINE_PROMPT, last_line='last_line')} AS prompt
FROM v WHERE contains(lower(verdict_text), 'yes')""")
def code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion examples whose last line a judge takes for code; one judge text in three is a whole file."""
    rows = completions(spark, sf_dir)
    slot = F.col("doc_ord") % 3
    said = F.when(slot == 0, "Yes").when(slot == 1, "No, it is a comment.").otherwise(F.col("code"))
    kept = qa.code_lines(rows, rows.select(*KEYS, "doc_ord", said.alias("verdict_text")))
    return kept.select(*KEYS, "doc_ord", "last_line", "prompt")


@query("completion_scores", f"""WITH {TAKEN},
a AS (SELECT doc_ord, left_tokens, [string_split(code, chr(10))[1], left_tokens, string_split(last_line, chr(10))[1]] AS out FROM taken)
SELECT doc_ord, round({sql_edit_score('out', 'left_tokens')}, 8) AS auto_acc,
       round(list_avg(list_transform(out, lambda o: ({q.verdict('o')})::INTEGER)), 8) AS llm_acc FROM a""")
def completion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = completions(spark, sf_dir)
    outs = F.array("code", F.concat("left_tokens", F.lit("\nmore")), "last_line")
    answers = rows.withColumns({"out": outs, "judges": F.transform(outs, lambda o: text.before(o, "\n"))})
    return qa.score_completions(answers).select(
        "doc_ord", F.round("auto_acc", 8).alias("auto_acc"), F.round("llm_acc", 8).alias("llm_acc")
    )
