"""Source adapters: one document's text -> an array of claim drafts, as Column expressions.

An adapter names intermediate columns (so that nothing is computed twice) and
has two expressions over them: ``drafts`` and ``fault`` (a message where the
document as a whole can't be used, else null). A draft's value sits in the one
typed column that fits its field; all null means that it couldn't be
normalized.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import lookups as L
from ledgerloom.functions import normalize as N
from ledgerloom.functions import parsing as P
from ledgerloom.functions.text import blank, find_distinct, full_match, jtrim, lines_of, strip

EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:bigint>"
DRAFT = f"struct<field_path:string,raw:string,value_str:string,value_num:double,value_exp:{EXPERIENCE},value_edu:{EDUCATION},method:string>"
NO_DRAFTS = f"array<{DRAFT}>"



def draft(field: str | Column, raw: Column, method: str, text: Column | None = None, number: Column | None = None, experience: Column | None = None, education: Column | None = None) -> Column:
    pick = lambda x: F.lit(None) if x is None else x
    field = F.lit(field) if isinstance(field, str) else field
    return F.struct(
        field.alias("field_path"),
        raw.alias("raw"),
        pick(text).cast("string").alias("value_str"),
        pick(number).cast("double").alias("value_num"),
        pick(experience).cast(EXPERIENCE).alias("value_exp"),
        pick(education).cast(EDUCATION).alias("value_edu"),
        F.lit(method).alias("method"),
    ).cast(DRAFT)


def drafts_of(*parts: tuple[Column | None, Column]) -> Column:
    """Concatenates (condition, draft or array of drafts) parts; a condition that isn't true contributes nothing."""
    none = F.array().cast(NO_DRAFTS)
    whole = [F.coalesce(F.when(condition, part) if condition is not None else part, none) for condition, part in parts]
    return F.concat(none, *whole)


def one(condition: Column, made: Column) -> tuple[Column, Column]:
    return condition, F.array(made)


def each(values: Column, make: Callable[[Column], Column], keep: Callable[[Column], Column] | None = None) -> tuple[None, Column]:
    return None, F.transform(F.filter(values, keep) if keep else values, make)


def experience(company: Column, title: Column, start: Column, end: Column, summary: Column) -> Column:
    return F.struct(company.alias("company"), title.alias("title"), start.alias("start"), end.alias("end"), summary.alias("summary"))


def education(institution: Column, degree: Column, field: Column, end_year: Column) -> Column:
    return F.struct(institution.alias("institution"), degree.alias("degree"), field.alias("field"), end_year.alias("end_year"))


Stage = dict[str, Column]


def location_stages(text: str, name: str) -> list[Stage]:
    """Columns NAME_parts, NAME_last and NAME_code of the location in column ``text``."""
    last = F.get(F.col(f"{name}_parts"), F.size(f"{name}_parts") - 1)
    return [{f"{name}_parts": P.location_parts(F.col(text))}, {f"{name}_last": last}, {f"{name}_code": N.country(F.col(f"{name}_last"))}]


def location_drafts(text: str, name: str, method: str) -> tuple[Column, Column]:
    """One part is a country or a city; two a city and a country or region; more: city, region, and the last as country."""
    parts, last, code = (F.col(f"{name}_{x}") for x in ("parts", "last", "code"))
    n = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    city = draft("location.city", at(0), method, N.text(at(0)))
    value = F.coalesce(code, N.text(last))
    end = draft(F.when((n > 2) | code.isNotNull(), "location.country").when(n == 1, "location.city").otherwise("location.region"), last, method, value)
    middle = draft("location.region", at(1), method, N.text(at(1)))
    return ~blank(F.col(text)), F.when(n == 1, F.array(end)).when(n == 2, F.array(city, end)).when(n > 2, F.array(city, middle, end))


def location_fault(text: str, name: str) -> Column:
    """A location of commas and white space alone breaks its whole document."""
    return F.when(~blank(F.col(text)) & (F.size(f"{name}_parts") == 0), "extract failed: location without parts")


def link_drafts(value: Column, method: str) -> Column:
    """A draft for a string that isn't blank, else null."""
    url = strip(value)
    return F.when(~blank(value), draft(P.link_field(url), url, method, url))


@dataclass(frozen=True)
class Adapter:
    """stages: columns to compute one after another from ``content`` (and ``doc``, its JSON value, if json), each named once."""

    stages: list[Stage]
    drafts: Column
    fault: Column
    json: bool = False


def _skills(values: Column, method: str) -> tuple[None, Column]:
    return each(values, lambda s: draft("skills", s, method, N.skill(s)), lambda s: s.isNotNull() & ~blank(s))


def _merged(*stages: list[Stage]) -> list[Stage]:
    """Lists of stages side by side."""
    return [{k: v for s in stages if i < len(s) for k, v in s[i].items()} for i in range(max(map(len, stages)))]


def _csv() -> Adapter:
    content, v = F.col("content"), (lambda c: F.col(f"csv_{c}"))
    names = ["name", "email", "phone", "current_company", "title", "location"]
    lines = F.filter(lines_of(content), lambda line: ~blank(line))
    stages = [
        {"csv_lines": lines},
        {"csv_header": P.csv_fields(F.get("csv_lines", F.lit(0))), "csv_row": P.csv_fields(F.get("csv_lines", F.lit(1)))},
        {f"csv_{c}": F.when(F.size("csv_lines") >= 2, F.nullif(P.csv_value(F.col("csv_header"), F.col("csv_row"), c), F.lit(""))) for c in names},
        *location_stages("csv_location", "csv_place"),
    ]
    has = lambda c: v(c).isNotNull()
    role = experience(N.text(v("current_company")), N.text(v("title")), F.lit(None), F.lit("present"), F.lit(None))
    drafts = drafts_of(
        one(has("name"), draft("full_name", v("name"), "csv_column:name", N.name(v("name")))),
        one(has("email"), draft("emails", v("email"), "csv_column:email", N.email(v("email")))),
        one(has("phone"), draft("phones", v("phone"), "csv_column:phone", N.phone_e164(v("phone")))),
        one(has("current_company") | has("title"), draft("experience", F.get("csv_lines", F.lit(1)), "csv_row:current_role", experience=role)),
        one(has("title"), draft("headline", v("title"), "csv_column:title", N.text(v("title")))),
        location_drafts("csv_location", "csv_place", "csv_column:location"),
    )
    return Adapter(stages, drafts, location_fault("csv_location", "csv_place"))


def _not_json() -> Column:
    return F.when(F.col("doc").isNull() & ~blank(F.col("content")), "extract failed: not a JSON value")


def _ats() -> Adapter:
    d, v = F.col("doc"), (lambda c: F.col(f"ats_{c}"))
    first = {
        "name": ("candidateName", "fullName", "name"),
        "headline": ("currentHeadline", "headline", "summary"),
        "years": ("yearsOfExperience", "experienceYears", "yoe"),
        "place": ("geo", "location"),
        "emails": ("contactEmails", "emails", "email"),
        "phones": ("contactPhones", "phones", "phone"),
        "skills": ("skillTags", "skills"),
        "links": ("profileUrls", "links"),
    }
    of_place = {"city": ("city", "town"), "region": ("state", "region"), "nation": ("country", "countryCode")}
    stages = [
        {f"ats_{k}_json": P.first_of(d, *keys) for k, keys in first.items()},
        {
            "ats_name": P.string_only(v("name_json")),
            "ats_headline": P.string_only(v("headline_json")),
            "ats_years": P.number_only(v("years_json")),
            "ats_location": P.string_only(v("place_json")),
            **{f"ats_{k}_json": F.when(P.is_object(v("place_json")), P.first_of(v("place_json"), *keys)) for k, keys in of_place.items()},
            "ats_links": F.transform(P.as_list(v("links_json")), P.string_only),
            "ats_skills": F.transform(P.as_list(v("skills_json")), P.string_only),
            "ats_emails": P.as_list(v("emails_json")),
            "ats_phones": P.as_list(v("phones_json")),
        },
        *location_stages("ats_location", "ats_spot"),
    ]
    part = lambda k, field, method, f: one(v(f"{k}_json").isNotNull(), draft(field, P.as_text(v(f"{k}_json")), method, f(P.string_only(v(f"{k}_json")))))
    drafts = drafts_of(
        one(~blank(v("name")), draft("full_name", v("name"), "ats:candidateName", N.name(v("name")))),
        each(v("emails"), lambda x: draft("emails", P.as_text(x), "ats:contactEmails", N.email(P.string_only(x))), lambda x: x.isNotNull()),
        each(v("phones"), lambda x: draft("phones", P.as_text(x), "ats:contactPhones", N.phone_e164(F.when(P.kind(x).rlike(P.NUMBERS) | (P.kind(x) == "STRING"), P.as_text(x)))), lambda x: x.isNotNull()),
        one(~blank(v("headline")), draft("headline", v("headline"), "ats:currentHeadline", N.text(v("headline")))),
        one(v("years").isNotNull(), draft("years_experience", v("years").cast("string"), "ats:yearsOfExperience", number=v("years"))),
        part("city", "location.city", "ats:geo.city", N.text),
        part("region", "location.region", "ats:geo.state", N.text),
        part("nation", "location.country", "ats:geo.country", N.country),
        location_drafts("ats_location", "ats_spot", "ats:location"),
        _skills(v("skills"), "ats:skillTags"),
        each(v("links"), lambda x: link_drafts(x, "ats:profileUrls"), lambda x: ~blank(x)),
    )
    return Adapter(stages, drafts, F.coalesce(_not_json(), location_fault("ats_location", "ats_spot")), json=True)


def _github() -> Adapter:
    d, v = F.col("doc"), (lambda c: F.col(f"github_{c}"))
    keys = ["name", "login", "bio", "blog", "location", "languages"]
    stages = [
        {f"github_{k}_json": P.child(d, k) for k in keys},
        {
            "github_url": F.concat(F.lit("https://github.com/"), P.as_text(v("login_json"))),
            "github_blog": P.string_only(v("blog_json")),
            "github_location": P.string_only(v("location_json")),
            "github_skills": F.transform(P.as_list(v("languages_json")), P.string_only),
        },
        *location_stages("github_location", "github_spot"),
    ]
    text = lambda k, field, f: one(v(f"{k}_json").isNotNull(), draft(field, P.as_text(v(f"{k}_json")), f"github_api:{k}", f(P.string_only(v(f"{k}_json")))))
    drafts = drafts_of(
        text("name", "full_name", N.name),
        one(v("url").isNotNull(), draft("links.github", v("url"), "github_api:login", v("url"))),
        text("bio", "headline", N.text),
        one(~blank(v("blog")), link_drafts(v("blog"), "github_api:blog")),
        location_drafts("github_location", "github_spot", "github_api:location"),
        _skills(v("skills"), "github_api:languages"),
    )
    return Adapter(stages, drafts, F.coalesce(_not_json(), location_fault("github_location", "github_spot")), json=True)


def _linkedin() -> Adapter:
    d, v = F.col("doc"), (lambda c: F.col(f"linkedin_{c}"))
    keys = ["name", "headline", "profileUrl", "location", "experience", "education", "skills"]
    words = lambda x, k: N.text(P.string_only(P.child(x, k)))
    stages = [
        {f"linkedin_{k}_json": P.child(d, k) for k in keys},
        {
            "linkedin_profile": P.string_only(v("profileUrl_json")),
            "linkedin_location": P.string_only(v("location_json")),
            "linkedin_skills": F.transform(P.as_list(v("skills_json")), P.string_only),
            "linkedin_roles": F.transform(
                F.filter(P.as_list(v("experience_json")), P.is_object),
                lambda x: F.struct(F.to_json(x).alias("raw"), *(words(x, k).alias(k) for k in ("company", "title", "summary")), *(P.as_text(P.child(x, k)).alias(k) for k in ("start", "end"))),
            ),
            "linkedin_studies": F.transform(
                F.filter(P.as_list(v("education_json")), P.is_object),
                lambda x: F.struct(
                    F.to_json(x).alias("raw"),
                    F.when(P.has_key(x, "school"), words(x, "school")).otherwise(words(x, "institution")).alias("school"),
                    *(words(x, k).alias(k) for k in ("degree", "field")),
                    F.when(P.has_key(x, "end"), P.as_text(P.child(x, "end"))).otherwise(P.as_text(P.child(x, "end_year"))).alias("end"),
                ),
            ),
        },
        *location_stages("linkedin_location", "linkedin_spot"),
    ]

    def role(x: Column) -> Column:
        ended = F.when(F.coalesce(blank(x["end"]), F.lit(True)), "present").otherwise(N.date_ym(x["end"]))
        return draft("experience", x["raw"], "linkedin:experience", experience=experience(x["company"], x["title"], N.date_ym(x["start"]), ended, x["summary"]))

    study = lambda x: draft("education", x["raw"], "linkedin:education", education=education(x["school"], x["degree"], x["field"], N.year(x["end"])))
    text = lambda k, field, f: one(v(f"{k}_json").isNotNull(), draft(field, P.as_text(v(f"{k}_json")), f"linkedin:{k}", f(P.string_only(v(f"{k}_json")))))
    drafts = drafts_of(
        text("name", "full_name", N.name),
        text("headline", "headline", N.text),
        one(v("profile").isNotNull(), draft("links.linkedin", v("profile"), "linkedin:profileUrl", jtrim(v("profile")))),
        location_drafts("linkedin_location", "linkedin_spot", "linkedin:location"),
        each(v("roles"), role),
        each(v("studies"), study),
        _skills(v("skills"), "linkedin:skills"),
    )
    broken = F.when(v("profileUrl_json").isNotNull() & v("profile").isNull(), "extract failed: profileUrl is no string")
    return Adapter(stages, drafts, F.coalesce(_not_json(), broken, location_fault("linkedin_location", "linkedin_spot")), json=True)


def _found_stages(name: str) -> Stage:
    """Distinct e-mail addresses and phone numbers of a text, each beside its normalized form."""
    beside = lambda found, f: F.transform(found, lambda x: F.struct(x.alias("raw"), f(x).alias("value")))
    content = F.col("content")
    return {f"{name}_emails": beside(find_distinct(content, L.FIND_EMAIL), N.email), f"{name}_phones": F.filter(beside(find_distinct(content, L.FIND_PHONE), N.phone_e164), lambda x: x["value"].isNotNull())}


def _resume() -> Adapter:
    content, v = F.col("content"), (lambda c: F.col(f"resume_{c}"))
    bare = lambda lines: F.transform(lines, lambda line: F.struct(line.alias("raw"), F.regexp_replace(strip(line), F.lit(L.BULLETS), F.lit("")).alias("bare")))
    lines = F.filter(F.transform(lines_of(content), jtrim), lambda line: line != "")
    stages = _merged(
        [_found_stages("resume")],
        [{"resume_first": F.get(lines, F.lit(0))}],
        [{"resume_sections": P.sections(content)}, {f"resume_{k}_lines": P.lines_under(F.col("resume_sections"), k) for k in ("skills", "experience", "education")}],
    )
    stages.append({
        "resume_skills": P.skill_tokens(v("skills_lines")),
        "resume_roles": F.filter(bare(v("experience_lines")), lambda x: x["bare"].rlike(L.EXPERIENCE_LINE)),
        "resume_studies": F.filter(bare(v("education_lines")), lambda x: x["bare"].rlike(L.EDUCATION_LINE)),
    })

    def role(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x["bare"], L.EXPERIENCE_LINE, i)
        return draft("experience", x["raw"], "resume:experience_section", experience=experience(N.text(part(2)), N.text(part(1)), N.date_ym(part(3)), N.date_ym(part(4)), F.lit(None)))

    def study(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x["bare"], L.EDUCATION_LINE, i)
        return draft("education", x["raw"], "resume:education_section", education=education(N.text(part(3)), N.text(part(1)), N.text(part(2)), part(4).cast("long")))

    drafts = drafts_of(
        each(v("emails"), lambda x: draft("emails", x["raw"], "resume:regex_email", x["value"])),
        each(v("phones"), lambda x: draft("phones", x["raw"], "resume:regex_phone", x["value"])),
        one(full_match(v("first"), L.NAME_LINE), draft("full_name", v("first"), "resume:first_line", N.name(v("first")))),
        each(v("skills"), lambda s: draft("skills", s, "resume:skills_section", N.skill(s))),
        each(v("roles"), role),
        each(v("studies"), study),
    )
    return Adapter(stages, drafts, F.lit(None).cast("string"))


def _notes() -> Adapter:
    v = lambda c: F.col(f"notes_{c}")
    drafts = drafts_of(
        each(v("phones"), lambda x: draft("phones", x["raw"], "notes:regex_phone", x["value"])),
        each(v("emails"), lambda x: draft("emails", x["raw"], "notes:regex_email", x["value"])),
        each(v("skills"), lambda s: draft("skills", s, "notes:skill_phrase", N.skill(s))),
    )
    return Adapter([_found_stages("notes") | {"notes_skills": P.phrase_skills(F.col("content"))}], drafts, F.lit(None).cast("string"))


_MAKERS: dict[str, Callable[[], Adapter]] = {"recruiter_csv": _csv, "ats_json": _ats, "github_api": _github, "linkedin": _linkedin, "resume": _resume, "recruiter_notes": _notes}
_made: dict[tuple[int, str], Adapter] = {}


def registry(*kinds: str) -> dict[str, Adapter]:
    """The adapters of the given source types, or of all, by type.

    Building one takes thousands of calls to the JVM, more time than small
    tables take to read; so only those asked for are built, once a JVM.
    """
    jvm = id(SparkContext._gateway)
    for kind in kinds or _MAKERS:
        if (jvm, kind) not in _made:
            _made[jvm, kind] = _MAKERS[kind]()
    return {kind: _made[jvm, kind] for kind in kinds or _MAKERS}
