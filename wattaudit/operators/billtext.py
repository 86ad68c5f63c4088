"""Bill rows and customer names from the text of billing histories."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattaudit.functions.text import ACCOUNT, DATE, norm_caps, norm_space, repair_scan
from wattaudit.functions.values import clean_number, parse_date
from wattaudit.session import work_dir

# Tokens of a history row and where a customer name stands.
_INT = r"-?[\d,]+"
_NUM = r"-?[\d,]*\.?\d+"
_MONEY = r"\$?-?[\d,]*\.?\d+"
_HEADER_NAME = (
    r"(?is)Customer[:\s]+(.+?)(?=\s+(?:Post Office:|Service Address:|Bill Account:|Monthly|Page\s+\d+|$))"
)
_ROW_NAME = rf"{ACCOUNT}\s*([A-Z0-9 &'.,\-/]{{3,}}?)\s+(?={DATE})"
_ACCOUNT_LABEL = rf"Bill Account[:\s]+({ACCOUNT})"

# A row: two dates, days, kWh, demand, load factor, rkVA, three amounts, then more amounts up to the next token of
# another kind. An account number is no amount.
_TAIL = rf"(?:\s+(?!\d{{7,12}}(?!\S)){_MONEY}(?!\S))+"
_ROW = (
    rf"(?<!\S){DATE}\s+{DATE}\s+{_INT}\s+{_INT}\s+{_NUM}\s+{_NUM}\s+{_INT}"
    rf"(?:\s+{_MONEY}){{3}}{_TAIL}"
)
_OPEN, _CLOSE, _END = "\x01", "\x02", "\x03"


def clean_text(c: Column | str, nfkc: bool = True) -> Column:
    """Text of a document with white space squashed and scan errors repaired."""
    return repair_scan(norm_space(c, nfkc))


def with_clean_text(docs: DataFrame, text: str = "text", nfkc: bool = True) -> DataFrame:
    """``docs`` with the text cleaned, once per document: an array of one text is unfolded, and later expressions are not
    merged across that, or they would repeat the cleaning.
    """
    return docs.withColumn(text, F.explode(F.array(clean_text(text, nfkc))))


def _row_names(text: Column) -> Column:
    """Names in the history rows, as ``norm_caps`` has them. They hold none but its characters, so only blanks are squashed."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(_ROW_NAME), 1), lambda n: F.trim(F.when(n.contains("  "), F.regexp_replace(n, " +", " ")).otherwise(n))
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _similarities(header: pd.Series, names: pd.Series) -> pd.Series:
    """Matching-block ratio of the header name and each candidate; null for documents that need none."""
    return pd.Series(
        [None if h is None else [SequenceMatcher(None, h, n).ratio() for n in ns] for h, ns in zip(header, names)],
        dtype="object",
    )


def _with_customer(docs: DataFrame, text: str, min_similarity: float) -> DataFrame:
    """Add ``customer`` (see ``canonical_customer``); everything happens inside the row of the document."""
    t = F.col(text)
    raw = _row_names(t)
    docs = docs.withColumns(
        {"_header": norm_caps(F.regexp_extract(t, _HEADER_NAME, 1)), "_names": F.filter(raw, lambda n: n != "")}
    )
    # Equal names stand together after sorting, the earliest first; a run of them is a group.
    docs = docs.withColumn(
        "_sorted", F.sort_array(F.transform("_names", lambda n, i: F.struct(n.alias("name"), i.alias("pos"))))
    )
    places = F.when(F.size("_sorted") > 0, F.sequence(F.lit(0), F.size("_sorted") - 1))

    def begins(i: Column) -> Column:
        return (i == 0) | (F.get("_sorted", i)["name"] != F.get("_sorted", i - 1)["name"])

    docs = docs.withColumn("_starts", F.filter(places, begins))

    def group(start: Column, k: Column) -> Column:
        first = F.get("_sorted", start)
        count = F.coalesce(F.get("_starts", k + 1), F.size("_sorted")) - start
        return F.struct(
            count.alias("n"), F.length(first["name"]).alias("len"), (-first["pos"]).alias("first"),
            first["name"].alias("name"),
        )

    docs = docs.withColumn("_groups", F.transform("_starts", group))
    docs = docs.withColumn("_best", F.array_max("_groups")["name"])
    header, best = F.col("_header"), F.col("_best")
    extends = best.startswith(header) & (F.length(best) > F.length(header))
    compared = (header != "") & best.isNotNull() & ~extends
    docs = docs.withColumn(
        "_sims", _similarities(F.when(compared, header), F.when(compared, F.transform("_groups", lambda g: g["name"])))
    )
    scored = F.zip_with(
        "_sims", "_groups",
        lambda s, g: F.struct(s.alias("sim"), g["len"].alias("len"), g["first"].alias("first"), g["name"].alias("name")),
    )
    docs = docs.withColumn("_alike", F.array_max(scored))
    alike = (F.col("_alike.sim") >= min_similarity) & (F.col("_alike.len") >= F.length(header))
    customer = F.when(best.isNull(), header).when(compared & alike, F.col("_alike.name")).otherwise(best)
    helpers = ("_header", "_names", "_sorted", "_starts", "_groups", "_best", "_sims", "_alike")
    return docs.withColumn("customer", customer).drop(*helpers)


def canonical_customer(docs: DataFrame, text: str = "text", min_similarity: float = 0.80) -> DataFrame:
    """One customer name per document (text already cleaned): doc_id, customer.

    Candidates are the names in the rows. The most frequent one (then longest, then first) wins if it extends the name
    in the header; otherwise the candidate most similar to the header, if similar enough and not shorter; otherwise the
    most frequent one; without candidates the header.
    """
    return _with_customer(docs, text, min_similarity).select("doc_id", "customer")


@F.pandas_udf(T.DoubleType())
def _ratio(header: pd.Series, name: pd.Series) -> pd.Series:
    """Matching-block ratio of two names."""
    return pd.Series([SequenceMatcher(None, h, n).ratio() for h, n in zip(header, name)], dtype="float64")


# Characters of cleaned names.
_LETTERS = [*"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 &'.,-/"]


def most_similarity(a: Column, b: Column) -> Column:
    """Upper bound of the matching-block ratio: no more characters can match than both names have of each."""

    def count(name: Column, letter: Column) -> Column:
        return F.length(name) - F.length(F.replace(name, letter, F.lit("")))

    shared = F.aggregate(
        F.array(*[F.lit(c) for c in _LETTERS]), F.lit(0), lambda total, c: total + F.least(count(a, c), count(b, c))
    )
    return 2 * shared / (F.length(a) + F.length(b))


def similarities(pairs: DataFrame, least: float) -> DataFrame:
    """(header, name, sim) of the different pairs of ``pairs`` whose ratio is at least ``least``.

    Lengths bound the ratio, then letter counts do; only what passes both travels to Python, each pair once.
    """
    different = pairs.select("header", "name").distinct()
    shorter, longer = (f(F.length("header"), F.length("name")) for f in (F.least, F.greatest))
    near = different.where(2 * shorter >= F.lit(least) * (shorter + longer)).where(most_similarity(F.col("header"), F.col("name")) >= least)
    same = near.where("header = name").withColumn("sim", F.lit(1.0))
    rest = near.where("header <> name").withColumn("sim", _ratio("header", "name"))
    return same.unionByName(rest).where(F.col("sim") >= least)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def account_customers(docs: DataFrame, text: str = "text", min_similarity: float = 0.80) -> DataFrame:
    """(bill_account, customer): one name per account, from all its documents (text already cleaned).

    Candidates are the names in the rows of all documents, the header is the most frequent one of the headers (then the longest, then
    the first in the alphabet). The rule is that of ``canonical_customer``, ties by the alphabet. A document without account
    label has the account null, which has no customer; an account without any name has the customer null.

    Names are counted per account before they meet; of the accounts whose most frequent name does not go on from the header, the different
    (header, name) pairs are compared once each, however many accounts have them.
    """
    t = F.col(text)
    account = F.nullif(norm_space(F.regexp_extract(t, f"(?i){_ACCOUNT_LABEL}", 1), False), F.lit(""))
    header = norm_caps(F.regexp_extract(t, _HEADER_NAME, 1))
    rows = F.transform(_row_names(t), lambda n: F.struct(F.lit("row").alias("kind"), n.alias("name")))
    heads = F.array(F.struct(F.lit("head").alias("kind"), header.alias("name")))
    named = docs.select(account.alias("bill_account"), F.explode(F.concat(heads, rows)).alias("n")).select("bill_account", "n.*")
    counts = named.where("bill_account is not null").groupBy("bill_account", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    # Names and accounts are written once, as several steps need them: every text is read once.
    path = work_dir(docs.sparkSession, "account-names")
    counts = _written(counts, f"{path}/counts")
    counts = counts.withColumn("place", F.when(F.col("name") != "", F.struct((-F.col("n")).alias("n"), (-F.length("name")).alias("len"), "name")))
    accounts = counts.groupBy("bill_account").agg(
        F.coalesce(F.min(F.when(F.col("kind") == "head", F.col("place")))["name"], F.lit("")).alias("header"),
        F.min(F.when(F.col("kind") == "row", F.col("place")))["name"].alias("best"),
    )
    accounts = _written(accounts, f"{path}/accounts")
    extends = F.col("best").startswith(F.col("header")) & (F.length("best") > F.length("header"))
    open_ = accounts.where((F.col("header") != "") & F.col("best").isNotNull() & ~extends).select("bill_account", "header")
    asked = counts.where("kind = 'row' and name <> ''").select("bill_account", "name").join(open_, "bill_account")
    found = asked.join(similarities(asked, min_similarity), ["header", "name"])
    top = found.groupBy("bill_account").agg(F.min(F.struct((-F.col("sim")).alias("sim"), (-F.length("name")).alias("len"), "name"))["name"].alias("top"))
    alike = F.col("top").isNotNull() & (F.length("top") >= F.length("header"))
    customer = F.when(alike, F.col("top")).otherwise(F.coalesce("best", F.nullif(F.col("header"), F.lit(""))))
    return accounts.join(top, "bill_account", "left").select("bill_account", customer.alias("customer"))


def _rows_of(text: Column) -> Column:
    """Array of (row, rest): each history row and the text between it and the next one; the last rest ends in a mark."""
    marked = F.regexp_replace(F.concat(text, F.lit(f" {_END}")), _ROW, f"{_OPEN}$0{_CLOSE}")
    pieces = F.split(marked, _OPEN)
    return F.transform(F.filter(pieces, lambda p: p.contains(_CLOSE)), lambda p: F.split(p, _CLOSE))


def _number(token: Column, to: str = "double") -> Column:
    return clean_number(token, to=to)


def _whole(token: Column) -> Column:
    return F.regexp_replace(token, r"[^\d\-]", "").try_cast("bigint")


def bill_rows(
    docs: DataFrame, text: str = "text", nfkc: bool = True, cleaned: bool = False, min_similarity: float = 0.80
) -> DataFrame:
    """Bills of documents (doc_id, text): one row per history row, typed, with account and customer of the document.

    After the three amounts of a row comes the retracted amount. Of exactly two dollar amounts in front of a number, a
    date or a page footer the first is a leftover and the second counts; otherwise the first one counts and later ones
    are leftovers. The first plain number up to 100 behind it is the sales-tax factor.

    A document is read inside its own row, so the whole extraction is one stage without a shuffle.
    """
    ready = docs.select("doc_id", F.col(text).alias("text"))
    ready = ready if cleaned else with_clean_text(ready, "text", nfkc)
    found = _with_customer(ready, "text", min_similarity).select(
        "doc_id",
        F.nullif(F.col("customer"), F.lit("")).alias("customer"),
        F.nullif(norm_space(F.regexp_extract("text", f"(?i){_ACCOUNT_LABEL}", 1), False), F.lit("")).alias("bill_account"),
        F.posexplode(_rows_of(F.col("text"))).alias("row_no", "piece"),
    )
    found = found.withColumns(
        {
            "token": F.split(F.get("piece", F.lit(0)), r"\s+"),
            "next": F.regexp_extract(F.get("piece", F.lit(1)), r"^\s*(\S+)", 1),
        }
    )
    tail = F.slice("token", F.lit(11), F.size("token"))
    # Pieces are cut at the next row, so an empty rest means that its date follows.
    bounded = (
        (F.col("next") == "")
        | F.col("next").rlike(f"^{DATE}$")
        | (F.lower("next") == "page")
        | F.translate("next", ",", "").rlike(rf"^{_NUM}$")
    )
    found = found.withColumns({"tail": tail, "bounded": bounded})
    dollars = F.filter("tail", lambda t: t.startswith("$"))
    plain_after = F.size("tail") > F.size(dollars)
    second = (F.size(dollars) == 2) & (F.col("bounded") | plain_after)
    found = found.withColumns(
        {
            "retracted": F.when(second, F.get(dollars, F.lit(1))).otherwise(
                F.coalesce(F.get(dollars, F.lit(0)), F.get("tail", F.lit(0)))
            )
        }
    )
    place = F.array_position("tail", F.col("retracted")).cast("int")
    behind = F.slice("tail", place + 1, F.size("tail"))
    factors = F.filter(
        F.transform(F.filter(behind, lambda t: ~t.startswith("$")), lambda t: _number(t)), lambda v: v <= 100
    )

    def at(i: int) -> Column:
        return F.get("token", F.lit(i))

    return found.select(
        "doc_id",
        "row_no",
        "bill_account",
        "customer",
        parse_date(at(0)).alias("bill_date"),
        parse_date(at(1)).alias("read_date"),
        _whole(at(2)).cast("int").alias("days_used"),
        _whole(at(3)).cast("double").alias("billed_kwh"),
        F.round(_number(at(4)), 1).alias("billed_demand"),
        F.round(_number(at(5)), 2).alias("load_factor"),
        _whole(at(6)).cast("double").alias("billed_rkva"),
        _number(at(7), "decimal(18,2)").alias("bill_amount"),
        _number(at(8), "decimal(18,2)").alias("sales_tax_amt"),
        _number(at(9), "decimal(18,2)").alias("bill_amount_with_sales_tax"),
        _number(F.col("retracted"), "decimal(18,2)").alias("retracted_amt"),
        F.round(F.get(factors, F.lit(0)), 2).alias("sales_tax_factor"),
    )
