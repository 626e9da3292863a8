"""SQL twins of the queries over text corpora that SQL can express: properties that the results must have."""

SQL: dict[str, str] = {
    "p7_lengths": "select doc_id, coalesce(length(text), 0) > 0 as has_ids from documents",
    "p8_violations": "select doc_id, cast(0 as bigint) as uses from documents where false",
}
