"""Eleven raw posting shapes to one schema.

Each source has a fixed JSON schema, so parsing needs no inference pass; a row
is parsed by the schema of its own source, all in one pass over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed import REMOTE_TEXT
from ..functions.markup import strip_html

COLUMNS = ["job_id", "source", "title", "company", "location", "salary", "description", "apply_url", "posted_date", "remote_status"]

SCHEMAS = {
    "greenhouse": "id string, title string, location struct<name:string>, content string, absolute_url string, updated_at string",
    "lever": "id string, text string, categories struct<location:string,commitment:string>, salaryRange struct<min:string,max:string,currency:string>, "
             "descriptionPlain string, description string, applyUrl string, hostedUrl string, createdAt bigint",
    "ashby": "id string, title string, location string, compensation struct<summary:string>, descriptionPlain string, descriptionHtml string, "
             "applyUrl string, jobUrl string, publishedAt string, isRemote boolean",
    "remotive": "id string, title string, company_name string, candidate_required_location string, salary string, description string, url string, publication_date string",
    "remoteok": "id string, position string, company string, location string, salary_min bigint, salary_max bigint, description string, apply_url string, url string, date string, tags array<string>",
    "weworkremotely": "title string, company string, location string, description string, apply_url string, posted_date string",
    "workday": "bulletFields array<string>, externalPath string, title string, locationsText string, __location string, __company string, __description string, "
               "__applyUrl string, __startDate string, __postedDate string",
    "workable": "shortcode string, id string, title string, city string, state string, country string, locations array<struct<city:string,region:string,country:string>>, "
                "description string, application_url string, url string, shortlink string, published_on string, created_at string, telecommuting boolean, __company string",
    "recruitee": "id string, title string, location string, city string, state_name string, country string, description string, requirements string, "
                 "salary struct<min:string,max:string,currency:string>, careers_apply_url string, careers_url string, published_at string, created_at string, "
                 "remote boolean, company_name string, __company string",
    "bamboohr": "id string, jobOpeningName string, location struct<city:string,state:string>, isRemote boolean, __company string, __description string, __applyUrl string, __datePosted string",
    "careerpage": "identifier struct<value:string>, title string, hiringOrganization struct<name:string>, jobLocation struct<address:struct<addressLocality:string,addressRegion:string>>, "
                  "baseSalary struct<currency:string,value:struct<value:string,minValue:string,maxValue:string>>, description string, url string, __pageUrl string, "
                  "datePosted string, jobLocationType string",
}

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def some(*cs: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in cs])


def listed(*cs: Column) -> Column:
    text = F.array_join(F.array(*[some(c) for c in cs]), ", ")
    return F.when(text != "", text)


def flag(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.lit("remote"))


def pay(low: Column, high: Column, currency: Column) -> Column:
    blank = F.lit("")
    return F.trim(F.concat(F.coalesce(low, blank), F.lit("-"), F.coalesce(high, blank), F.lit(" "), F.coalesce(currency, blank)))


def utc_iso(value: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.trim(value), r"(?i)\s+UTC$", "Z"), " ", "T")
    return F.date_format(plain.try_cast("timestamp"), ISO)


def _fields(source: str, company: Column) -> dict[str, Column]:
    j = lambda f: F.col(f"_{source}.{f}")
    mentions = lambda c: c.rlike("(?i)" + REMOTE_TEXT)
    none, remote = F.lit(None).cast("string"), F.lit("remote")
    if source == "greenhouse":
        loc = some(j("location.name"))
        return dict(job_id=j("id"), title=j("title"), company=company, location=loc, salary=none, description=strip_html(j("content")),
                    apply_url=j("absolute_url"), posted_date=some(j("updated_at")), remote_status=flag(loc.rlike("(?i)remote")))
    if source == "lever":
        loc = some(j("categories.location"))
        return dict(job_id=j("id"), title=j("text"), company=company, location=loc,
                    salary=F.when(j("salaryRange").isNotNull(), pay(j("salaryRange.min"), j("salaryRange.max"), j("salaryRange.currency"))),
                    description=F.coalesce(some(j("descriptionPlain")), strip_html(j("description"))), apply_url=some(j("applyUrl"), j("hostedUrl")),
                    posted_date=F.date_format(F.timestamp_millis(F.nullif(j("createdAt"), F.lit(0))), ISO),
                    remote_status=flag(some(j("categories.location"), j("categories.commitment")).rlike("(?i)remote")))
    if source == "ashby":
        return dict(job_id=j("id"), title=j("title"), company=company, location=some(j("location")), salary=some(j("compensation.summary")),
                    description=F.coalesce(some(j("descriptionPlain")), strip_html(j("descriptionHtml"))), apply_url=some(j("applyUrl"), j("jobUrl")),
                    posted_date=some(j("publishedAt")), remote_status=flag(j("isRemote")))
    if source == "remotive":
        return dict(job_id=j("id"), title=j("title"), company=j("company_name"), location=some(j("candidate_required_location")), salary=some(j("salary")),
                    description=strip_html(j("description")), apply_url=j("url"), posted_date=some(j("publication_date")), remote_status=remote)
    if source == "remoteok":
        low, high = (F.nullif(j(c), F.lit(0)).cast("string") for c in ("salary_min", "salary_max"))
        return dict(job_id=j("id"), title=j("position"), company=j("company"), location=some(j("location")),
                    salary=F.when(low.isNotNull() | high.isNotNull(), pay(low, high, none)), description=strip_html(j("description")),
                    apply_url=some(j("apply_url"), j("url")), posted_date=some(j("date")), remote_status=remote)
    if source == "weworkremotely":
        url = some(j("apply_url"))
        last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
        return dict(job_id=F.coalesce(last, j("title")), title=j("title"), company=j("company"), location=some(j("location")), salary=none,
                    description=j("description"), apply_url=j("apply_url"), posted_date=some(j("posted_date")), remote_status=remote)
    if source == "workday":
        loc = some(j("__location"), j("locationsText"))
        return dict(job_id=some(F.get(j("bulletFields"), F.lit(0)), j("externalPath"), j("title")), title=j("title"), company=some(j("__company"), company),
                    location=F.when(~loc.rlike(r"(?i)^\d+\s+Locations?$"), loc), salary=none, description=strip_html(j("__description")), apply_url=j("__applyUrl"),
                    posted_date=some(j("__startDate"), j("__postedDate")), remote_status=flag(mentions(loc)))
    if source == "workable":
        first = lambda f: F.get(j("locations"), F.lit(0))[f]
        loc = listed(some(j("city"), first("city")), some(j("state"), first("region")), some(j("country"), first("country")))
        return dict(job_id=some(j("shortcode"), j("id")), title=j("title"), company=some(j("__company"), company), location=loc, salary=none,
                    description=strip_html(j("description")), apply_url=some(j("application_url"), j("url"), j("shortlink")),
                    posted_date=some(j("published_on"), j("created_at")), remote_status=flag(F.coalesce(j("telecommuting"), F.lit(False)) | F.coalesce(mentions(loc), F.lit(False))))
    if source == "recruitee":
        loc = F.coalesce(some(j("location")), listed(j("city"), j("state_name"), j("country")))
        body = F.array_join(F.array(some(j("description")), some(j("requirements"))), " ")
        return dict(job_id=j("id"), title=j("title"), company=some(j("__company"), j("company_name"), company), location=loc,
                    salary=F.when(some(j("salary.min")).isNotNull(), pay(j("salary.min"), j("salary.max"), j("salary.currency"))), description=strip_html(body),
                    apply_url=some(j("careers_apply_url"), j("careers_url")), posted_date=utc_iso(some(j("published_at"), j("created_at"))), remote_status=flag(j("remote")))
    if source == "bamboohr":
        loc = listed(j("location.city"), j("location.state"))
        return dict(job_id=j("id"), title=j("jobOpeningName"), company=some(j("__company"), company), location=loc, salary=none,
                    description=strip_html(j("__description")), apply_url=j("__applyUrl"), posted_date=some(j("__datePosted")),
                    remote_status=flag(F.coalesce(j("isRemote"), F.lit(False)) | F.coalesce(mentions(loc), F.lit(False))))
    value = j("baseSalary.value")
    url = some(j("url"), j("__pageUrl"))
    amount = F.concat(F.coalesce(value["value"], value["minValue"], F.lit("")),
                      F.when(F.length(value["maxValue"]) > 0, F.concat(F.lit("-"), value["maxValue"])).otherwise(""),
                      F.lit(" "), F.coalesce(j("baseSalary.currency"), F.lit("")))
    return dict(job_id=F.coalesce(some(j("identifier.value")), url, F.concat_ws("-", company, j("title"))), title=j("title"),
                company=F.coalesce(j("hiringOrganization.name"), company), location=listed(j("jobLocation.address.addressLocality"), j("jobLocation.address.addressRegion")),
                salary=F.when(value.isNotNull(), F.trim(amount)), description=strip_html(j("description")), apply_url=url,
                posted_date=some(j("datePosted")), remote_status=flag(j("jobLocationType") == "TELECOMMUTE"))


def require_known(raw: DataFrame, source: str = "source") -> DataFrame:
    """Fails on a row whose source has no normaliser."""
    known = F.col(source).isin(*SCHEMAS)
    error = F.raise_error(F.concat(F.lit("no normaliser for source: "), F.coalesce(F.col(source), F.lit("null")))).cast("string")
    return raw.withColumn(source, F.when(known, F.col(source)).otherwise(error))


def normalise(raw: DataFrame, source: str = "source", body: str = "raw", company: str = "company", extra: list[str] = ()) -> DataFrame:
    """Landed rows (source, company, JSON text) to the ten-column schema, in one scan.

    Every row is parsed by its own source's schema only; an unknown source raises.
    """
    known = require_known(raw, source)
    parsed = known.select(*extra, source, F.col(company).alias("_company"), *[F.when(F.col(source) == name, F.from_json(body, schema)).alias(f"_{name}") for name, schema in SCHEMAS.items()])
    row = F.lit(None)
    for name in SCHEMAS:
        cols = _fields(name, F.col("_company"))
        fields = F.struct(*[(F.lit(name) if c == "source" else cols[c].cast("string")).alias(c) for c in COLUMNS])
        row = F.when(F.col(source) == name, fields).otherwise(row)
    return parsed.select(*extra, row.alias("_row")).select(*extra, *[F.col(f"_row.{c}").alias(c) for c in COLUMNS])
