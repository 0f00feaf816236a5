"""Canonical table schemas, as Spark DDL."""

from __future__ import annotations

EVENT_SCHEMA = (
    """
    event_id STRING, ts TIMESTAMP, ingested_at TIMESTAMP, time_source STRING, owner_group STRING,
    source_id STRING, host STRING, vendor STRING, product STRING, parser_id STRING,
    parser_version STRING, parse_status STRING, parse_generation BIGINT, encoding_detected STRING,
    template_id STRING, signature_hash BIGINT, severity_num SMALLINT, ocsf_class_uid BIGINT,
    ocsf_activity_id INT, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, proto STRING,
    action STRING, outcome STRING, user_name STRING, attrs MAP<STRING,STRING>, body STRING,
    raw_ref STRING
    """
)

CHANGE_SCHEMA = (
    """
    ts TIMESTAMP, change_id STRING, owner_group STRING, target_kind STRING, target_id STRING,
    change_kind STRING, actor STRING, summary STRING, details MAP<STRING,STRING>, source STRING,
    external_ref STRING
    """
)

#: How "this column carries a value" is tested; columns without an entry are always filled.
FIELD_KINDS = {
    "source_id": "text",
    "host": "text",
    "vendor": "text",
    "product": "text",
    "parser_id": "text",
    "parser_version": "text",
    "encoding_detected": "text",
    "template_id": "text",
    "signature_hash": "number",
    "severity_num": "number",
    "ocsf_class_uid": "number",
    "ocsf_activity_id": "number",
    "src_ip": "address",
    "dst_ip": "address",
    "src_port": "number",
    "dst_port": "number",
    "proto": "text",
    "action": "text",
    "outcome": "text",
    "user_name": "text",
    "attrs": "map",
    "raw_ref": "text",
}

#: Columns a field filter may name, with the type its operand is cast to.
FILTERABLE_COLUMNS = {
    "source_id": "string",
    "host": "string",
    "vendor": "string",
    "product": "string",
    "parser_id": "string",
    "parser_version": "string",
    "template_id": "string",
    "signature_hash": "bigint",
    "proto": "string",
    "action": "string",
    "outcome": "string",
    "user_name": "string",
    "owner_group": "string",
    "time_source": "string",
    "severity_num": "smallint",
    "src_port": "int",
    "dst_port": "int",
    "ocsf_class_uid": "bigint",
    "ocsf_activity_id": "int",
    "src_ip": "string",
    "dst_ip": "string",
}

#: Columns the attribute-lift signal looks at.
LIFT_FIELDS = (
    "source_id",
    "host",
    "vendor",
    "product",
    "parser_id",
    "proto",
    "action",
    "outcome",
)

PARSE_STATUS_ORDINAL = {"ok": 1, "partial": 2, "failed": 3}
