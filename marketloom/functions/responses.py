"""Parsing of stored model responses: code fences, first JSON value, rules, records, rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .text import blank_to_null, col

_FIELD = "struct<name:string,selector:string,attr:string,required:boolean,transform:string>"
_SECTION = f"struct<item_selector:string,fields:array<{_FIELD}>>"
_SECTIONS = f"listing:{_SECTION},product_detail:{_SECTION},stores:{_SECTION}"
RULE_SCHEMA = f"struct<domain:string,page_type:string,notes:string,{_SECTIONS},output_shape:struct<{_SECTIONS}>>"
_ITEM = (
    "struct<entity_type:string,name:string,url:string,price:string,old_price:string,currency:string,"
    "category:string,brand:string,store_name:string,store_url:string,address:string,phone:string,"
    "image_url:string,confidence:string,reason:string,review_status:string>"
)
# Elements are read one by one, so that a stray one spoils no other.
ITEMS_SCHEMA = "struct<items:array<string>>"


def strip_fence(text: Column | str) -> Column:
    """Drop a Markdown code fence around the text."""
    body = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(body, r"^```[^\n]*\n?", ""), r"\n[ \t]*```[ \t]*$", "")
    return F.when(body.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(body)


@F.pandas_udf(T.StringType())
def _first_json(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def scan(text):
        if text is None:
            return None
        for match in re.finditer(r"[{\[]", text):
            try:
                return json.dumps(decoder.raw_decode(text, match.start())[0], ensure_ascii=False)
            except json.JSONDecodeError:
                continue
        return None

    return texts.map(scan)


def json_text(raw: Column | str) -> Column:
    """First JSON object or array in a response, NULL when there is none.

    A response that is JSON as a whole, or JSON inside a JSON string, stays in the JVM; only the
    rest goes through the scanner.
    """
    body = strip_fence(raw)
    unquoted = F.when(body.startswith('"'), strip_fence(F.get_json_object(F.concat(F.lit('{"v":'), body, F.lit("}")), "$.v")))
    body = F.coalesce(unquoted, body)
    whole = body.rlike(r"^[{\[]") & F.try_parse_json(body).isNotNull()
    return F.when(whole, body).otherwise(_first_json(F.when(~whole, body)))


def _clean_section(section: Column) -> Column:
    named = F.filter(section["fields"], lambda f: F.coalesce(f["name"], F.lit("")) != "")
    fields = F.transform(named, lambda f: F.struct(
        f["name"].alias("name"), F.coalesce(f["selector"], F.lit("")).alias("selector"), f["attr"].alias("attr"),
        F.coalesce(f["required"], F.lit(False)).alias("required"),
        F.when(f["transform"].isin(K.FIELD_TRANSFORMS), f["transform"]).alias("transform")))
    return F.struct(section["item_selector"].alias("item_selector"), fields.alias("fields"))


def rule_draft(parsed_json: Column | str) -> Column:
    """Rule struct of a response; sections may sit at the top or under ``output_shape``."""
    draft = F.from_json(col(parsed_json), RULE_SCHEMA)
    section = lambda name: _clean_section(F.coalesce(draft[name], draft["output_shape"][name]))
    return F.struct(
        draft["domain"].alias("domain"), F.coalesce(blank_to_null(draft["page_type"]), F.lit("unknown")).alias("page_type"),
        *[section(n).alias(n) for n in ("listing", "product_detail", "stores")],
        F.coalesce(draft["notes"], F.lit("")).alias("notes"))


def response_items(parsed_json: Column | str, default_confidence: float = 0.0) -> Column:
    """Normalised items of a response: defaults filled, entity type and confidence kept in range."""
    parsed = F.from_json(col(parsed_json), ITEMS_SCHEMA)
    held = F.transform(F.filter(parsed["items"], lambda x: F.coalesce(x.startswith("{"), F.lit(False))), lambda x: F.from_json(x, _ITEM))
    text = lambda v: F.trim(F.coalesce(v, F.lit("")))

    def item(x: Column) -> Column:
        kind = F.lower(text(x["entity_type"]))
        confidence = F.coalesce(x["confidence"].try_cast("double"), F.lit(default_confidence))
        plain = [n for n in ("name", "url", "category", "brand", "store_name", "store_url", "address", "phone", "image_url", "reason")]
        return F.struct(
            F.when(kind == "store", "store").otherwise("product").alias("entity_type"),
            *[text(x[n]).alias(n) for n in plain],
            x["price"].alias("price"), x["old_price"].alias("old_price"),
            F.coalesce(blank_to_null(text(x["currency"])), F.lit("VND")).alias("currency"),
            F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0))).alias("confidence"),
            F.coalesce(blank_to_null(text(x["review_status"])), F.lit("needs_review")).alias("review_status"))

    return F.coalesce(F.transform(held, item), F.array())


def synthetic_rows(parsed_json: Column | str, columns: Column, row_count: Column) -> Column:
    """First ``row_count`` rows projected to ``columns``; NULL when the response holds fewer."""
    text = col(parsed_json)
    bare = F.from_json(F.when(text.startswith("["), text), "array<map<string,string>>")
    held = F.from_json(F.when(text.startswith("{"), text), "struct<rows:array<map<string,string>>>")["rows"]
    rows = F.filter(F.slice(F.coalesce(bare, held), F.lit(1), row_count), lambda r: r.isNotNull())
    projected = F.transform(rows, lambda r: F.map_from_arrays(
        columns, F.transform(columns, lambda c: F.coalesce(F.try_element_at(r, c), F.lit("")))))
    return F.when(F.size(rows) == row_count, projected)
