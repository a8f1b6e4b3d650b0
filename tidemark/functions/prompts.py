"""Prompt rendering: a template with named holes becomes one concat expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.text import strip


def _pieces(template: str, holes: dict):
    """Split on the holes that are given; other braces stay plain text."""
    rest = template
    while rest:
        found = [(rest.find("{%s}" % name), name) for name in holes if "{%s}" % name in rest]
        if not found:
            yield rest, None
            return
        at, name = min(found)
        if at:
            yield rest[:at], None
        yield None, name
        rest = rest[at + len(name) + 2:]


def render(template: str, **holes: Column) -> Column:
    """NULL holes render as empty text."""
    parts = [
        F.lit(text) if name is None else F.coalesce(holes[name].cast("string"), F.lit(""))
        for text, name in _pieces(template, holes)
    ]
    return F.concat(*parts)


def render_by_model(templates: dict[str, str], model: Column, **holes: Column) -> Column:
    """Pick the template by model name; a model without one is an error."""
    branches = None
    for name, template in templates.items():
        value = render(template, **holes)
        branches = F.when(model == name, value) if branches is None else branches.when(model == name, value)
    return branches.otherwise(F.raise_error(F.concat(F.lit("no template for model "), model)))


def news_question(title: Column, published_date: Column, description: Column, content: Column) -> Column:
    return render(
        fixed.NEWS_QUESTION_PROMPT,
        title=title, published_date=published_date, description=description, content=content,
    )


def wiki_question(title: Column, content: Column) -> Column:
    return render(fixed.WIKI_QUESTION_PROMPT, title=title, content=content)


def answerable(question: Column) -> Column:
    return render(fixed.ANSWERABLE_PROMPT, question=question)


def answer(model: Column, question: Column) -> Column:
    return render_by_model(fixed.ANSWER_PROMPTS, model, question=question)


def code_line(last_line: Column) -> Column:
    return render(fixed.CODE_LINE_PROMPT, last_line=strip(last_line))


def judge(
    model: Column, question: Column, ref_answer: Column, out: Column,
    templates: dict[str, str] = fixed.FACT_JUDGE_PROMPTS,
) -> Column:
    return render_by_model(templates, model, question=question, ref_answer=ref_answer, out=out)


def code_judge(model: Column, ref_answer: Column, out: Column) -> Column:
    return render_by_model(
        fixed.CODE_JUDGE_PROMPTS, model,
        question=F.lit("None"), ref_answer=strip(ref_answer), out=strip(out),
    )


def batch_judge(question: Column, ref_answer: Column, out: Column) -> Column:
    return render(fixed.BATCH_JUDGE_PROMPT, question=question, ref_answer=ref_answer, out=out)
