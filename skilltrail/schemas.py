"""Table schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_WORDS = T.ArrayType(T.StringType())

LEXICON = _struct(skill=T.StringType(), formatted=T.StringType(), ord=T.LongType())
LISTINGS = _struct(
    career=T.StringType(),
    searched_at=T.TimestampType(),
    title=T.StringType(),
    location=T.StringType(),
    skills=_WORDS,
    listing_text=T.StringType(),
    unique_url=T.StringType(),
)
RULES = _struct(
    career=T.StringType(),
    antecedent=_WORDS,
    suggested=T.StringType(),
    confidence=T.DoubleType(),
    complexity=T.IntegerType(),
    rule_id=T.StringType(),
)
USER_SKILLS = _struct(user_id=T.LongType(), skill=T.StringType())
SKILL_ACTIONS = _struct(
    user_id=T.LongType(), skill=T.StringType(), action=T.StringType(), ts=T.TimestampType()
)
FEEDBACK = _struct(action=T.StringType(), suggestion=T.StringType(), ts=T.TimestampType())
SKILL_FEEDBACK = _struct(
    action=T.StringType(),
    formatted=T.StringType(),
    skill=T.StringType(),
    spellings=T.MapType(T.StringType(), T.LongType()),
    n=T.LongType(),
    last_ts=T.TimestampType(),
)
CAREER_FEEDBACK = _struct(career=T.StringType(), n=T.LongType())
CAREER_TITLES = _struct(category=T.StringType(), title=T.StringType(), career=T.StringType())
PAGES = _struct(page_id=T.LongType(), url=T.StringType(), html=T.StringType())
RESUMES = _struct(resume_id=T.LongType(), text=T.StringType())
CAREER_TERMS = _struct(career=T.StringType(), skill=T.StringType(), tf=T.LongType())
SKILL_IDF = _struct(skill=T.StringType(), df=T.LongType(), idf=T.DoubleType())
CAREER_VECTORS = _struct(career=T.StringType(), skill=T.StringType(), weight=T.DoubleType())
