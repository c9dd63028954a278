"""Record types of documents, sources, tasks, metrics and duplicate groups, as DDL strings for readers and ``createDataFrame``."""

RAW_DOCUMENTS = (
    "id STRING, source_id STRING NOT NULL, source_url STRING, source_type STRING NOT NULL, document_type STRING NOT NULL, raw_content STRING NOT NULL, "
    "raw_metadata MAP<STRING, STRING>, collected_at TIMESTAMP NOT NULL, collector_version STRING, processing_status STRING, processing_error STRING, "
    "processing_attempts INT, content_hash STRING, title STRING, author STRING, published_at TIMESTAMP, language STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
)
PROCESSED_DOCUMENTS = (
    "id STRING, raw_document_id STRING NOT NULL, title STRING, summary STRING, content STRING, structured_content STRING, extracted_metadata STRING, "
    "entities ARRAY<STRUCT<text: STRING, type: STRING>>, keywords ARRAY<STRING>, categories ARRAY<STRING>, processed_at TIMESTAMP NOT NULL, processor_version STRING, "
    "processing_time_ms INT, content_hash STRING, similarity_group_id STRING, similarity_score DOUBLE, is_duplicate BOOLEAN, quality_score DOUBLE, relevance_score DOUBLE, "
    "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
)
DATA_SOURCES = (
    "id STRING, name STRING NOT NULL, description STRING, source_type STRING NOT NULL, url STRING, config STRING, enabled BOOLEAN, collection_interval INT, "
    "max_items_per_run INT, retry_count INT, timeout INT, tags ARRAY<STRING>, category STRING, language STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL, "
    "last_collected_at TIMESTAMP, last_success_at TIMESTAMP, collection_count INT, success_count INT, error_count INT, last_error STRING"
)
COLLECTION_TASKS = (
    "id STRING, source_id STRING NOT NULL, task_type STRING, status STRING, priority INT, created_at TIMESTAMP NOT NULL, started_at TIMESTAMP, completed_at TIMESTAMP, "
    "worker_id STRING, retry_count INT, max_retries INT, items_collected INT, items_processed INT, items_failed INT, error_message STRING, error_details STRING, config STRING"
)
SYSTEM_METRICS = (
    "id STRING, timestamp TIMESTAMP NOT NULL, total_sources INT, active_sources INT, total_raw_documents INT, total_processed_documents INT, documents_last_24h INT, "
    "pending_tasks INT, running_tasks INT, completed_tasks INT, failed_tasks INT, cpu_usage_percent DOUBLE, memory_usage_mb DOUBLE, disk_usage_mb DOUBLE, "
    "avg_processing_time_ms DOUBLE, avg_collection_time_ms DOUBLE, error_rate_last_24h DOUBLE"
)
DUPLICATE_GROUPS = (
    "group_id STRING, created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL, representative_document_id STRING NOT NULL, document_count INT, "
    "similarity_threshold DOUBLE NOT NULL, total_content_length BIGINT, avg_content_length DOUBLE, min_published_at TIMESTAMP, max_published_at TIMESTAMP, "
    "detection_method STRING NOT NULL, detection_config STRING"
)
DUPLICATE_GROUP_MEMBERS = "group_id STRING, document_id STRING, similarity_score DOUBLE NOT NULL, added_at TIMESTAMP NOT NULL"
EXTRACTED_CONTENT = (
    "title STRING, content STRING, summary STRING, author STRING, publish_date STRING, tags ARRAY<STRING>, "
    "images ARRAY<STRUCT<src: STRING, alt: STRING, title: STRING, width: STRING, height: STRING>>, "
    "links ARRAY<STRUCT<href: STRING, text: STRING, title: STRING>>, metadata MAP<STRING, STRING>"
)
