"""What act documents say: the revision in force, the annex's address, and the effective date.

Documents are parsed inside their row; malformed ones give nulls or errors as columns, and never fail a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import strip_blank

#: The addresses that are put together.
SITE = "https://www.riigiteataja.ee"
ACT = SITE + "/public-api/api/v1/akt/"
ANNEX = SITE + "/aktilisa/1110/8202/6010/"
NO_REVISION = "kehtivRedaktsioon puudub"
NO_ANNEX = "Lisa 1 linki ei leitud"
BROKEN = "XML parsimine ebaõnnestus"


def resolve_revision(df: DataFrame, body: str = "body") -> DataFrame:
    """df with blob_url, the address of the revision in force, or error where the response names none: the number zero and
    other empty values name none, any text that isn't empty does."""
    named = F.get_json_object(F.col(body), "$.kehtivRedaktsioon")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(F.col(body)), "$.kehtivRedaktsioon", "variant"))
    text = F.coalesce(named, F.lit(""))
    there = (text != "") & ((kind == "STRING") | ~text.isin("0", "0.0", "-0", "-0.0", "false", "null", "[]", "{}"))
    return df.withColumn("_there", F.coalesce(there, F.lit(False))).withColumns({
        "blob_url": F.when(F.col("_there"), F.concat(F.lit(ACT), named, F.lit("/blob-xml"))),
        "error": F.when(~F.col("_there"), NO_REVISION),
    }).drop("_there")


def well_formed(xml: Column) -> Column:
    """Whether the text is XML that can be read; the path functions throw on other text."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_xml(xml, "_corrupt string, unused string", options)
    return xml.isNotNull() & parsed.isNotNull() & parsed["_corrupt"].isNull()


#: Parts what the one path returns; no XML document can hold it.
PART = "\x1e"


def _facts_path() -> str:
    """One path for all that is asked of a document: whether a paragraph names the first annex, the first file with 'lisa'
    in its name wherever it stands, whether there is a date, and the date. An element's text is what stands before its
    first child; prefixes are no part of its name."""
    named = lambda part: f"//*[contains(local-name(),'{part}')]"
    text = "text()[not(preceding-sibling::*)][1]"
    annex = f"{named('tavatekst')}[contains({text},'Lisa 1')]"
    file = f"({named('fail')}/@failNimi[contains(translate(.,'LISA','lisa'),'lisa')])[1]"
    date = f"({named('kehtivuseAlgus')}[{text}])[1]/{text}"
    return f"concat(boolean({annex}),'{PART}',string({file}),'{PART}',boolean({date}),'{PART}',string({date}))"


def act_facts(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """df with annex_url and annex_error, and effective_date. A document is checked once and read by one path.

    The annex's address is a fixed path and the file's name, whatever the name looks like. The date reads DD.MM.YYYY; one
    written otherwise stays as it is, a blank one is empty; null without one.
    """
    xml = F.col(xml_col)
    read = df.withColumn("_fine", well_formed(xml)).withColumn("_said", F.when(F.col("_fine"), F.xpath_string(xml, F.lit(_facts_path()))))
    parts = read.withColumn("_said", F.split("_said", PART))
    file, written = F.get("_said", 1), F.when(F.get("_said", 2) == "true", strip_blank(F.get("_said", 3)))
    named = parts.withColumns({"annex_url": F.when((F.get("_said", 0) == "true") & (file != ""), F.concat(F.lit(ANNEX), file)), "_written": written})
    iso = F.when(F.col("_written").rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date("_written", "y-M-d"))
    dated = named.withColumn("effective_date", F.coalesce(F.date_format(iso, "dd.MM.yyyy"), F.col("_written")))
    error = F.when(~F.col("_fine"), BROKEN).when(F.col("annex_url").isNull(), NO_ANNEX)
    return dated.withColumn("annex_error", error).drop("_fine", "_said", "_written")


def annex_url(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """df with annex_url, or annex_error."""
    return act_facts(df, xml_col).drop(*{"effective_date"} - set(df.columns))


def effective_date(df: DataFrame, xml_col: str = "xml") -> DataFrame:
    """df with effective_date."""
    return act_facts(df, xml_col).drop(*{"annex_url", "annex_error"} - set(df.columns))
