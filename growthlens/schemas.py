"""Explicit schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, L, DT = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.DateType()


def _items(elem: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("items", T.ArrayType(elem))])


def _props(*fields: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("properties", T.StructType(list(fields)))])


ADDRESS = T.StructType([T.StructField("city", S), T.StructField("region", S), T.StructField("country", S)])

# Company index entry (value of the keyed object)
INDEX_ENTRY = T.StructType([T.StructField("n", S), T.StructField("i", S), T.StructField("s", D),
                            T.StructField("c", T.ArrayType(S))])

# Category baseline (value of the keyed object)
CATEGORY_STATS = T.StructType([T.StructField("t", L), T.StructField("r", D), T.StructField("m", D),
                               T.StructField("d", D)])

# Exported ranking entry
RANK_ENTRY = T.StructType([T.StructField("p", S), T.StructField("s", D)])

# Organisation document -- every path the service reads
ORG_DOCUMENT = T.StructType([T.StructField("data", T.StructType([
    # page of a paged document: 0 = header (properties), n > 0 = a later
    # page of relationship items; a document without it is one whole page 0
    T.StructField("page", L),
    # a re-sent page carries a higher version; without one it counts as 0
    T.StructField("version", L),
    T.StructField("properties", T.StructType([
        T.StructField("permalink", S),
        T.StructField("name", S),
        T.StructField("short_description", S),
        T.StructField("homepage_url", S),
        T.StructField("total_funding_usd", D),
        T.StructField("num_employees_min", I),
        T.StructField("num_employees_max", I),
        T.StructField("founded_on", DT),
        T.StructField("closed_on", DT),
        T.StructField("number_of_investments", I),
    ])),
    T.StructField("relationships", T.StructType([
        T.StructField("acquired_by", _items(T.StructType([
            T.StructField("type", T.StructType([T.StructField("announced_on", DT)]))]))),
        T.StructField("headquarters", T.StructType([
            T.StructField("item", T.StructType([T.StructField("properties", ADDRESS)]))])),
        T.StructField("offices", _items(T.StructType([T.StructField("properties", ADDRESS)]))),
        T.StructField("competitors", _items(_props(T.StructField("permalink", S)))),
        T.StructField("products", _items(_props(T.StructField("name", S)))),
        T.StructField("investments", _items(T.StructType([
            T.StructField("relationships", T.StructType([
                T.StructField("funding_round", _props(T.StructField("money_raised_usd", D)))]))]))),
        T.StructField("acquisitions", _items(_props(T.StructField("name", S)))),
        T.StructField("investors", _items(T.StructType([T.StructField("type", S)]))),
        T.StructField("funding_rounds", _items(_props(T.StructField("money_raised_usd", D),
                                                      T.StructField("announced_on", DT)))),
        T.StructField("categories", _items(_props(T.StructField("name", S)))),
    ])),
]))])

CORRUPT = "_corrupt_record"
ORG_DOCUMENT_WITH_CORRUPT = T.StructType(ORG_DOCUMENT.fields + [T.StructField(CORRUPT, S)])
