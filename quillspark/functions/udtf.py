"""Table functions over the text of a note, for SQL and for `LATERAL`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillspark.functions import markdown as M


@udtf(returnType="line int, level int, title string, section string")
class Sections:
    """Each heading of a note with the text that stands below it, lines counted in the body from 0."""

    def eval(self, content: str):
        body = M.body_of(content or "")
        heads, lines = M.outline(body), [line.rstrip("\r\n") for line, _ in M.lines_with_code(body)]
        for n, (at, level, title) in enumerate(heads):
            end = next((b for b, lower, _ in heads[n + 1 :] if lower <= level), len(lines))
            yield at, level, title, "\n".join(lines[at:end])


@udtf(returnType="line string")
class Toc:
    def eval(self, content: str):
        for line in M.toc(content or ""):
            yield (line,)


@udtf(returnType="chunk_index int, breadcrumb string, preview string, embed_text string")
class Chunks:
    def eval(self, stem: str, content: str):
        header, body, _ = M.parse_leniently(content or "")
        for i, c in enumerate(M.chunks(stem or "", header, body)):
            yield i, c.breadcrumb, c.preview, c.embed_text


@udtf(returnType="target string, target_stem string")
class Wikilinks:
    def eval(self, content: str):
        for target in M.wikilinks(content or ""):
            yield target, M.target_stem(target)


@udtf(returnType="row int, cells array<string>")
class MdTableRows:
    def eval(self, content: str):
        for i, cells in enumerate(M.table_rows(M.body_of(content or ""))):
            yield i, cells


FUNCTIONS = {"sections": Sections, "toc": Toc, "chunks": Chunks, "wikilinks": Wikilinks, "md_table_rows": MdTableRows}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
