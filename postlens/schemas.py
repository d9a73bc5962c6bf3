"""Schemas of the data the engine reads and writes.

Every scan gets one of these, so no job is spent on inference and a field that
is absent from the input is a NULL instead of an analysis error.
"""

from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# The field names below are those of the payloads and files that are read.

POST = StructType([StructField("id", StringType()), StructField("text", StringType())])

# One paged search response: the posts of the page and the token of the next page.
PAGE = StructType(
    [
        StructField("data", ArrayType(POST)),
        StructField("meta", StructType([StructField("next_token", StringType())])),
    ]
)

# The same with the account of each post, where the service was asked for it.
ACCOUNT_POST = StructType([*POST.fields, StructField("account", StringType())])
ACCOUNT_PAGE = StructType([StructField("data", ArrayType(ACCOUNT_POST)), PAGE["meta"]])

# A page as stored with what it was asked for with: the account, and the token that the page
# before it named, which the first page lacks.
CHAINED_PAGE = StructType(
    [*ACCOUNT_PAGE.fields, StructField("account", StringType()), StructField("token", StringType())]
)

# One line of the post stream.
STREAM_LINE = StructType([StructField("data", POST)])

# The same with the account of the post.
ACCOUNT_LINE = StructType([StructField("data", ACCOUNT_POST)])

# The answer of the rules service: the ids of the rules in force.
RULES_RESPONSE = StructType(
    [
        StructField("data", ArrayType(StructType([StructField("id", StringType())]))),
        StructField("meta", StructType([StructField("sent", StringType())])),
    ]
)

RULES = StructType([StructField("value", StringType()), StructField("tag", StringType())])

# The positional form of a lexicon line, all fields still `name=value`.
LEXICON_FIELDS = StructType(
    [
        StructField(name, StringType())
        for name in ("type", "length", "word", "pos1", "stemmed1", "sentiment")
    ]
)

TOKEN_ROWS = StructType(
    [StructField("id", StringType()), StructField("text", ArrayType(StringType()))]
)

# What the streams publish batch by batch.
LABELS = StructType(
    [StructField("id", StringType()), StructField("score", LongType()), StructField("label", StringType())]
)
COUNTS = StructType([StructField("label", StringType()), StructField("n", LongType())])
RULED_TOKENS = StructType([*TOKEN_ROWS.fields, StructField("account", StringType()), StructField("tag", StringType())])
REJECTED = StructType([StructField("value", StringType())])
BATCH_COUNTS = StructType(
    [StructField(name, LongType()) for name in ("n_lines", "n_rejected", "rules_version")]
)
