"""Code changes: records out of a review service's JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERSON = "struct<name:string,email:string,username:string,value:int>"
SCHEMA = f"subject string, project string, owner struct<name:string,email:string,username:string>, labels struct<`Code-Review`:struct<all:array<{PERSON}>>,`Developer-Verified`:struct<all:array<{PERSON}>>>"
PREFIX = r"^\)\]\}'\s*"


def decoded(body: Column) -> Column:
    """SC31: the record of a response, whose first line guards against its use as a script; NULL if it is no JSON."""
    return F.from_json(F.regexp_replace(body, PREFIX, ""), SCHEMA)


def record(body: Column, number: Column, host: str) -> Column:
    """SC39, SC32: address, message, repository, owner, reviewers and approvers of a change; what is missing is empty.

    Votes of both labels count, of people with a user name: 2 approves, 1 reviews unless it is the owner's own.
    """
    change = decoded(body)
    owner = change["owner"]
    blank = F.lit("")
    none = F.array().cast(f"array<{PERSON}>")
    votes = F.concat(*[F.coalesce(change["labels"][label]["all"], none) for label in ("Code-Review", "Developer-Verified")])
    votes = F.filter(votes, lambda v: v["username"].isNotNull() & v["value"].isNotNull())
    person = lambda v: F.struct(v["name"].alias("name"), v["email"].alias("email"), v["username"].alias("username"))
    own = F.coalesce(owner["username"], blank)
    return F.struct(
        F.concat(F.lit(f"{host}/"), number.cast("string")).alias("url"),
        F.coalesce(change["subject"], blank).alias("message"),
        F.coalesce(change["project"], blank).alias("repository"),
        F.struct(*[F.coalesce(owner[k], blank).alias(k) for k in ("name", "email", "username")]).alias("owner"),
        F.transform(F.filter(votes, lambda v: (v["value"] == 1) & (v["username"] != own)), person).alias("reviewers"),
        F.transform(F.filter(votes, lambda v: v["value"] == 2), person).alias("approvers"),
    )


def merged_maps(a: Column, b: Column) -> Column:
    """Two maps of maps of lists as one: keys of either, lists of the same place one after the other."""

    def lists(x: Column, y: Column) -> Column:
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.concat(x, y))

    def inner(x: Column, y: Column) -> Column:
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.map_zip_with(x, y, lambda _, p, q: lists(p, q)))

    return F.map_zip_with(a, b, lambda _, x, y: inner(x, y))
