"""Semi-structured feeds as DataFrames: whole files in, one row a record out.

JSON goes through Spark's own parser. HTML tables, script arrays and wikitext need a tokenizer that SQL lacks; they are
read in Arrow batches, one file at a time, so files are spread over the cluster and none is collected.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import json_or_jsonp

TABLE_ROWS = "path string, table_no int, css string, row_no int, header boolean, cells array<string>, links array<string>"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of whole text files below ``path``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


class _Tables(HTMLParser):
    """Rows of all tables, outer and nested, with the class of their table and the first link of each cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, str, int, bool, list[str], list[str | None]]] = []
        self.count, self.stack = 0, []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.stack.append({"no": self.count, "css": attrs.get("class") or "", "rows": 0, "row": None})
            self.count += 1
        elif self.stack and tag == "tr":
            self._close_row()
            self.stack[-1]["row"] = {"cells": [], "links": [], "head": True}
        elif self.stack and tag in ("td", "th") and self.stack[-1]["row"] is not None:
            row = self.stack[-1]["row"]
            row["cells"].append("")
            row["links"].append(None)
            row["head"] &= tag == "th"
        elif tag == "a" and self.stack and self.stack[-1]["row"] and self.stack[-1]["row"]["links"] and self.stack[-1]["row"]["links"][-1] is None:
            self.stack[-1]["row"]["links"][-1] = attrs.get("href")
        elif tag == "br":
            self.handle_data(" ")

    def handle_data(self, data):
        if self.stack and self.stack[-1]["row"] and self.stack[-1]["row"]["cells"]:
            self.stack[-1]["row"]["cells"][-1] += data

    def handle_endtag(self, tag):
        if self.stack and tag == "tr":
            self._close_row()
        elif self.stack and tag == "table":
            self._close_row()
            self.stack.pop()

    def _close_row(self):
        top = self.stack[-1]
        row = top["row"]
        if row and row["cells"]:
            self.rows.append((top["no"], top["css"], top["rows"], row["head"], [" ".join(c.split()) for c in row["cells"]], row["links"]))
            top["rows"] += 1
        top["row"] = None


def html_rows(files: DataFrame, css: str | None = None) -> DataFrame:
    """One row a table row of (path, body); ``css`` keeps tables whose class holds the word. Broken HTML gives what was read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, body in zip(batch["path"], batch["body"]):
                parser = _Tables()
                parser.feed(body or "")
                parser.close()
                out += [(path, *row) for row in parser.rows if css is None or css in row[1].split()]
            yield pd.DataFrame(out, columns=["path", "table_no", "css", "row_no", "header", "cells", "links"])

    return files.select("path", "body").mapInPandas(read, TABLE_ROWS)


def html_records(rows: DataFrame) -> DataFrame:
    """(path, table_no, row_no, record) with ``record`` a map from the table's first header row; other headers fall out."""
    heads = rows.filter("header").groupBy("path", "table_no").agg(F.min(F.struct("row_no", "cells")).alias("h")).select("path", "table_no", F.transform("h.cells", lambda c: F.lower(c)).alias("names"))
    body = rows.filter("not header").join(heads, ["path", "table_no"])
    n = F.least(F.size("names"), F.size("cells"))
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("names", i).alias("k"), F.element_at("cells", i).alias("v")))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return body.select("path", "table_no", "row_no", F.map_from_entries(first).alias("record"))


def script_array(body: str, name: str = "data") -> str | None:
    """The bracketed array after ``name:`` or ``name =`` in a script, by matching brackets outside of strings."""
    found = re.search(rf"[\"']?\b{re.escape(name)}[\"']?\s*[:=]\s*\[", body or "")
    if not found:
        return None
    depth, quote, start, i = 0, "", found.end() - 1, found.end() - 1
    while i < len(body):
        c = body[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return body[start : i + 1]
        i += 1
    return None


def script_rows(files: DataFrame, schema: str, name: str = "data") -> DataFrame:
    """Rows of the JSON array that a page assigns to ``name``; ``schema`` is the array's DDL. Pages without it give none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "json": [script_array(b, name) for b in batch["body"]]})

    arrays = files.select("path", "body").mapInPandas(cut, "path string, json string").filter("json is not null")
    return arrays.select("path", F.from_json("json", schema).alias("rows"))


def page_attribute(body, attribute: str = "data-page"):
    """JSON held by an HTML attribute, its entities resolved (expression)."""
    out = F.regexp_extract(body, f"{attribute}=\"([^\"]*)\"", 1)
    for entity, char in (("&quot;", '"'), ("&#039;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.nullif(out, F.lit(""))


def json_payload(files: DataFrame, schema: str) -> DataFrame:
    """(path, payload) of JSON or JSONP bodies; unreadable bodies have a null payload."""
    return files.select("path", F.from_json(json_or_jsonp(F.col("body")), schema).alias("payload"))


def draft_picks(payloads: DataFrame) -> DataFrame:
    """Picks of a draft feed: forfeited ones and those without a position fall out.

    The payload has draftYear and picks (round, overallPick, teamAbbrev, firstName, lastName, positionCode, countryCode,
    height in inches, weight in pounds, amateurLeague, amateurClubName).
    """
    picks = payloads.select("payload.draftYear", F.explode("payload.picks").alias("p")).select("draftYear", "p.*")
    named = picks.withColumn("name", F.concat_ws(" ", "firstName.default", "lastName.default"))
    real = named.filter((F.trim("name") != "") & ~F.lower("name").contains("forfeit") & (F.coalesce("positionCode", F.lit("")) != ""))
    return real.select(
        F.format_string("%d-%03d", "draftYear", "overallPick").alias("player_id"), "name", F.col("draftYear").alias("draft_year"), "round", F.col("overallPick").alias("overall_pick"), F.col("teamAbbrev").alias("team_id"),
        F.col("positionCode").alias("position"), F.col("countryCode").alias("nationality"), F.round(F.col("height") * 2.54).cast("int").alias("height_cm"), F.round(F.col("weight") * 0.45359237).cast("int").alias("weight_kg"), F.col("amateurLeague").alias("league"), F.col("amateurClubName").alias("team"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; lines that are no JSON object fall out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def wiki_rows(text: str) -> list[list[str]]:
    """Cells of the first wikitext table, row by row; templates, references and markup taken out."""
    table = re.search(r"\{\|.*?\n\|\}", text or "", re.S)
    if not table:
        return []
    out = []
    for chunk in re.split(r"\n\|-[^\n]*", table.group()[2:-2]):
        cells = []
        for line in chunk.split("\n"):
            if line and line[0] in "|!" and line[:2] not in ("|+", "|}"):
                cells += [re.sub(r"^[^\[\]{}|]*\|(?!\|)", "", c) for c in re.split(r"\|\||!!", line[1:])]
        if cells:
            out.append([plain_wiki(c) for c in cells])
    return out


def plain_wiki(text: str) -> str:
    out = re.sub(r"<ref[^>]*/>|<ref.*?</ref>|<[^>]+>", "", text, flags=re.S)
    out = re.sub(r"\{\{[^{}]*\}\}", "", out)
    out = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", out)
    return " ".join(entities.unescape(out.replace("'''", "").replace("''", "")).split())


def wiki_table(files: DataFrame) -> DataFrame:
    """(path, row_no, cells) of the first table of each (path, body) page."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, i, row) for p, b in zip(batch["path"], batch["body"]) for i, row in enumerate(wiki_rows(b))]
            yield pd.DataFrame(out, columns=["path", "row_no", "cells"])

    return files.select("path", "body").mapInPandas(read, "path string, row_no int, cells array<string>")


def infobox(body):
    """Map of ``| key = value`` fields of a page (expression); of a repeated key the first counts."""
    fields = F.regexp_extract_all(body, F.lit("(?m)^\\s*\\|\\s*([a-zA-Z_ ]+?\\s*=[^\\n]*)$"), F.lit(1))
    pairs = F.transform(fields, lambda f: F.struct(F.trim(F.substring_index(f, "=", 1)).alias("k"), F.trim(F.regexp_replace(f, "^[^=]*=", "")).alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1))


# The columns of a skater's and a goalie's line of text in a guide.
SKATER_LINE = "^(?<season>\\d{4}-\\d{2})\\s+(?<body>.+?)\\s+(\\d+)\\s+(\\d+)\\s+(\\d+)\\s+(\\d+)$"
GOALIE_LINE = "^(?<season>\\d{4}-\\d{2})\\s+(?<body>.+?)\\s+(\\d+)\\s+(\\d+\\.\\d{2})\\s+(0?\\.\\d{3})$"


def text_stat_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """``lines`` that read as a goalie's or a skater's statistics, with season, body, games and the measures of its kind."""
    t = F.trim(F.col(text))
    goalie, skater = t.rlike(GOALIE_LINE), t.rlike(SKATER_LINE)
    number = lambda p, i, kind: F.regexp_extract(t, p, i).try_cast(kind)
    out = lines.withColumn("kind", F.when(goalie, "goalie").when(skater, "skater")).filter("kind is not null")
    return out.withColumns({
        "season": F.substring(t, 1, 7), "body": F.when(goalie, F.regexp_extract(t, GOALIE_LINE, 2)).otherwise(F.regexp_extract(t, SKATER_LINE, 2)),
        "games": F.when(goalie, number(GOALIE_LINE, 3, "int")).otherwise(number(SKATER_LINE, 3, "int")),
        "goals": F.when(~goalie, number(SKATER_LINE, 4, "int")), "assists": F.when(~goalie, number(SKATER_LINE, 5, "int")), "points": F.when(~goalie, number(SKATER_LINE, 6, "int")),
        "goals_against_average": F.when(goalie, number(GOALIE_LINE, 4, "double")), "save_percentage": F.when(goalie, number(GOALIE_LINE, 5, "double")),
    })
