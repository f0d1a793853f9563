"""Explicit schemas (DDL): no inference pass, and only the fields a job reads."""

# One schema per job, since nested JSON fields are not pruned by the optimizer.
SENTIMENT_POST = (
    "entities struct<hashtags: array<struct<text: string>>>, "
    "tone struct<sentiment: string>"
)
TONE_POST = (
    "entities struct<hashtags: array<struct<text: string>>>, "
    "tone struct<sentiment: string, document_tone: "
    "struct<tones: array<struct<tone_name: string, score: double>>>>"
)
TAG_TEXT_POST = "hashtags string, state string"

# Field names of the public Spark event log.
EVENT = (
    "`Event` string, `App Name` string, `Timestamp` long, "
    "`Job ID` long, `Stage IDs` array<long>, `Properties` map<string, string>, "
    "`Submission Time` long, `Stage ID` long, "
    "`Stage Info` struct<`Stage ID`: long, `Number of Tasks`: long, "
    "`Submission Time`: long, `Completion Time`: long>, "
    "`Task Info` struct<`Task ID`: long, `Launch Time`: long, "
    "`Finish Time`: long, `Failed`: boolean>, "
    "`Job Result` struct<`Result`: string>"
)

HISTORY = (
    "account_id string, user_id string, event string, job_type string, "
    "job_id string, job_handle string, data string, ts timestamp"
)

ENVELOPE = "handle string, success boolean, data string, options string"
