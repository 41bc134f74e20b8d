"""Text of one JSON line in each of the corpus formats, as column expressions.

A normaliser takes the line and gives the text, or null where the record is to
be left out. Lines that aren't JSON objects give null (``on_error="null"``, the
default, which drops them) or an error (``"fail"``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import int_or_zero, strip

PILE_SETS = ("Pile-CC", "OpenWebText2", "Wikipedia (en)")
QUESTION, DETAIL, ANSWER = "问题：", "问题描述：", "回答："


def _json(line: Column, schema: str, on_error: str) -> Column:
    return F.from_json(line, schema, {"mode": "FAILFAST" if on_error == "fail" else "PERMISSIVE"})


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def jsonl(line: Column, on_error: str = "null") -> Column:
    """The field ``text``."""
    return _json(line, "text STRING", on_error)["text"]


def ccnews(line: Column, on_error: str = "null") -> Column:
    """Title, description and main text; more than 100 characters in all. The
    description is left out where the main text begins with it."""
    d = _json(line, "title STRING, description STRING, maintext STRING", on_error)
    title, about, main = (_or_empty(d[k]) for k in ("title", "description", "maintext"))
    text = F.concat(
        F.when(title != "", F.concat(strip(title), F.lit(" "))).otherwise(""),
        F.when((about != "") & ((main == "") | ~F.startswith(main, about)), F.concat(strip(about), F.lit(" "))).otherwise(""),
        main,
    )
    return F.when(F.length(text) > 100, text)


def baike(line: Column, on_error: str = "null") -> Column:
    """Title, abstract and content in a row, unless empty."""
    d = _json(line, "title STRING, abstract STRING, content STRING", on_error)
    text = F.concat(*(_or_empty(d[k]) for k in ("title", "abstract", "content")))
    return F.when(text != "", text)


def zhihu(line: Column, on_error: str = "null") -> Column:
    """Question and answer, if the answer has more than 100 characters or more
    than 1000 votes."""
    d = _json(line, "`q_title` STRING, `q-content` STRING, `ans-content` STRING, `ans-up-num` STRING", on_error)
    answer = d["ans-content"]
    good = (F.length(_or_empty(answer)) > 100) | (int_or_zero(d["ans-up-num"]) > 1000)
    detail = F.when(d["q-content"].isNotNull(), F.concat(F.lit(DETAIL), d["q-content"])).otherwise("")
    return F.when(good, F.concat(F.lit(QUESTION), d["q_title"], detail, F.lit(ANSWER), answer))


def zhidao(line: Column, on_error: str = "null") -> Column:
    """Question, its best answer of more than 10 characters, and all others of
    more than 100 in their order."""
    d = _json(line, "title STRING, content STRING, best_answer STRUCT<content: STRING>, other_answers ARRAY<STRUCT<content: STRING>>", on_error)
    content, best = _or_empty(d["content"]), _or_empty(d["best_answer"]["content"])
    others = F.filter(F.coalesce(d["other_answers"], F.array().cast("array<struct<content:string>>")), lambda a: F.length(a["content"]) > 100)
    return F.concat(
        F.lit(QUESTION), d["title"],
        F.when(content != "", F.concat(F.lit(DETAIL), content)).otherwise(""),
        F.lit(ANSWER),
        F.when(F.length(best) > 10, best).otherwise(""),
        F.array_join(F.transform(others, lambda a: a["content"]), ""),
    )


def pile(line: Column, sets: Sequence[str] = PILE_SETS, on_error: str = "null") -> Column:
    """The field ``text`` of records of the allowed sets."""
    d = _json(line, "text STRING, meta STRUCT<pile_set_name: STRING>", on_error)
    return F.when(d["meta"]["pile_set_name"].isin(*sets), _or_empty(d["text"]))


def raw_txt(line: Column, on_error: str = "null") -> Column:
    """The line itself."""
    return line


FORMATS: dict[str, Callable[..., Column]] = {"raw_txt": raw_txt, "jsonl": jsonl, "ccnews": ccnews, "baike": baike, "zhihu": zhihu, "zhidao": zhidao, "pile": pile}


def normalizer(name: str | None) -> Callable[..., Column]:
    """The normaliser of a format; none and '' mean raw lines."""
    try:
        return FORMATS[name or "raw_txt"]
    except KeyError:
        raise ValueError(f"unknown text format: {name!r}") from None
