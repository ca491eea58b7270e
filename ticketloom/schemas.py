"""Fixed schemas of the landed documents."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


PERSON = "STRUCT<id BIGINT, type STRING, first STRING, last STRING, email STRING, photoUrl STRING>"
ATTACHMENT = "STRUCT<id BIGINT, filename STRING, mimeType STRING, size BIGINT>"
SOURCE = "STRUCT<type STRING, via STRING>"
_THREAD = (
    f"id BIGINT, type STRING, status STRING, state STRING, body STRING, createdAt STRING, createdBy {PERSON}, assignedTo {PERSON}, customer {PERSON}, "
    f"attachments ARRAY<{ATTACHMENT}>, source {SOURCE}, action STRUCT<text STRING, type STRING>, _embedded STRUCT<attachments ARRAY<{ATTACHMENT}>>"
)
_CONVERSATION = (
    "id BIGINT, number BIGINT, subject STRING, status STRING, state STRING, type STRING, mailboxId BIGINT, createdAt STRING, userUpdatedAt STRING, closedAt STRING, preview STRING, "
    f"primaryCustomer {PERSON}, assignee {PERSON}, closedBy BIGINT, closedByUser {PERSON}, createdBy {PERSON}, customerWaitingSince STRUCT<friendly STRING, time STRING>, threads INT, "
    "tags ARRAY<STRUCT<id BIGINT, name STRING, slug STRING, color STRING>>, customFields ARRAY<STRUCT<id BIGINT, value STRING>>, cc ARRAY<STRING>, bcc ARRAY<STRING>, "
    f"source {SOURCE}, photoUrl STRING, _embedded STRUCT<threads ARRAY<STRUCT<{_THREAD}>>>"
)
_VALUES = "ARRAY<STRUCT<id BIGINT, type STRING, value STRING>>"
_CUSTOMER = (
    "id BIGINT, firstName STRING, lastName STRING, email STRING, phone STRING, background STRING, organization STRING, gender STRING, draft BOOLEAN, photoType STRING, photoUrl STRING, createdAt STRING, "
    f"_embedded STRUCT<emails {_VALUES}, phones {_VALUES}, chats {_VALUES}, social_profiles {_VALUES}, websites {_VALUES}, properties ARRAY<STRUCT<name STRING, slug STRING, type STRING>>>"
)
_USER = "id BIGINT, firstName STRING, lastName STRING, email STRING, role STRING, type STRING, phone STRING, photoUrl STRING, alternateEmails ARRAY<STRING>, createdAt STRING"
_ORGANIZATION = "id BIGINT, name STRING, domain STRING, domains ARRAY<STRING>, note STRING"
_SAVED_REPLY = "id BIGINT, name STRING, subject STRING, private BOOLEAN, text STRING"
_ARTICLE = "id STRING, name STRING, slug STRING, status STRING, collectionId STRING, categories ARRAY<STRING>, related ARRAY<STRING>, updatedAt STRING, viewCount BIGINT"

_DDL = {"THREAD": _THREAD, "CONVERSATION": _CONVERSATION, "CUSTOMER": _CUSTOMER, "USER": _USER, "ORGANIZATION": _ORGANIZATION, "SAVED_REPLY": _SAVED_REPLY, "ARTICLE": _ARTICLE}


def __getattr__(name: str) -> T.StructType:
    """``schemas.THREAD`` and the like; parsed when asked for, as that takes a running session."""
    if name in _DDL:
        return _s(_DDL[name])
    raise AttributeError(name)


def embedded_page(item: T.DataType, *keys: str) -> T.StructType:
    """A page document: items under ``_embedded.<key>`` and page numbers."""
    inner = T.StructType([T.StructField(k, T.ArrayType(item)) for k in keys])
    page = _s("number INT, size INT, totalElements BIGINT, totalPages INT")
    return T.StructType([T.StructField("_embedded", inner), T.StructField("page", page)])


def docs_page(item: T.StructType, key: str) -> T.StructType:
    """A docs page: items under ``<key>.items``; or the object itself, whose fields then stand at the top."""
    inner = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("pages", T.IntegerType()), T.StructField("count", T.LongType()), T.StructField("items", T.ArrayType(item))])
    return T.StructType([T.StructField(key, inner), *item.fields])
