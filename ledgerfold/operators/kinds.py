"""Telling a form, a norms order and a registry extract apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.text import normalize

# --- fixed values: wording that tells the kind of a file -----------------------
DOCUMENT_FILE = "(?iu)\\.(docx|pdf)$"
FORM_WORDS = "коэффициент плотности|расчетн[а-я]* масс"
NORM_NAME, NORM_WORDS = "наименование категори", "куб|кг в год|норматив накопления"
CATEGORY_WORD, REGISTRY_WORDS = "категор", "расчетн|зон[аы] деятельн|муниципальн|адрес|источник"
NORM_FILE, FORM_FILE, REGISTRY_FILE = "(?iu)норматив", "(?iu)общи[хе]\\s*сведени", "(?iu)реестр|иоо"
HEADER_DEPTH = 12


def detect_kinds(files: DataFrame, grids: DataFrame) -> DataFrame:
    """Kind of every file by its name and the text of its first rows.

    Only the first rows of the tables are read; their cells are joined per row
    and the rows per file.  ``files`` is ``(file)``.
    """
    top = grids.filter(F.col("row_idx") < HEADER_DEPTH)
    row_text = F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit(""))), " ")
    titles = top.groupBy("file", "table_idx").agg(
        F.max("title").alias("title"), F.sort_array(F.collect_list(F.struct("row_idx", row_text.alias("text")))).alias("rows")
    )
    texts = titles.groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("table_idx", "title", F.col("rows.text").alias("body")))).alias("sheets")
    )
    titles = F.array_join(F.transform("sheets", lambda s: s["title"]), " ")
    body = F.array_join(F.flatten(F.transform("sheets", lambda s: s["body"])), " ")
    header = normalize(F.concat_ws(" ", titles, body))
    name, text = F.col("file"), F.col("header")
    kind = (
        F.when(name.rlike(DOCUMENT_FILE), "norms")
        .when(text.rlike(FORM_WORDS), "template")
        .when(text.rlike(NORM_NAME) & text.rlike(NORM_WORDS), "norms")
        .when(text.rlike(CATEGORY_WORD) & text.rlike(REGISTRY_WORDS), "registry")
        .when(name.rlike(NORM_FILE), "norms")
        .when(name.rlike(FORM_FILE), "template")
        .when(name.rlike(REGISTRY_FILE), "registry")
        .otherwise("unknown")
    )
    known = files.join(texts, "file", "left").withColumn("header", F.coalesce(header, F.lit("")))
    return known.select("file", kind.alias("kind"))
