"""Declared schemas; nothing is inferred from data."""

from __future__ import annotations

COMPANIES = "company_id int, company_name string, logo string, record_creation_time timestamp_ntz"
COUNTRIES = "country_id int, country_name string"
LOCATIONS = "location_id int, city string, latitude double, longitude double, country_id int"
FIELDS = "field_id int, root_field string, sub_field string"
FIELD_JOBS = "job_id string, field_id int"
JOBS = (
    "job_id string, title string, workplace_type string, posted_date timestamp_ntz, "
    "job_state string, description string, short_description string, experience string, "
    "skills_required string, apply_link string, embedding array<float>, portal string, "
    "record_creation_time timestamp_ntz, company_id int, location_id int"
)
REJECTED_JOBS = "user_id int, job_id string, timestamp timestamp"
RESUMES = "resume_id string, user_id int, version string, text string, vector array<float>"
ALREADY_APPLIED = "user_id int, job_ids array<string>"
APPLIED_JOBS = "user_id int, job_id string"
COOLED_JOBS = "job_id string"
USER_OPERATIONS = "user_id int, experience string, timestamp timestamp, seq bigint"
LOCATION_FILTER = "country: string, city: string, latitude: double, longitude: double, radius_km: double"
MATCH_REQUESTS = (
    f"request_id string, user_id int, locations array<struct<{LOCATION_FILTER}>>, "
    "keywords array<string>, fields array<int>, experience array<string>, company string, "
    "is_remote_only boolean, sort_type string, offset int"
)
SEARCH_REQUESTS = "user_id int, time timestamp, location array<double>, keywords array<string>"
TRAINING_SAMPLES = (
    "sample_id string, resume_id string, resume_text string, positive_job_id string, "
    "positive_job_text string, hard_negative_job_ids array<string>, "
    "hard_negative_job_texts array<string>, source string, timestamp string, mining_strategy string"
)
TAXONOMY = (
    "skills array<struct<id: string, name: string, canonical_name: string, category: string, "
    "aliases: array<string>, description: string, popularity: double>>, "
    "relations array<struct<source_id: string, target_id: string, relation_type: string, "
    "weight: double, metadata: map<string, string>>>"
)
RAW_SCORES = "raw_score double"
LOGO_MAP = "input_company string, matched_name string, identifier string, logo_url string, error string"
METRIC = "name string, metric_value double, type string, sample_rate double, tags map<string,string>"

#: columns of the flat job row
STAR_COLUMNS = (
    "job_id", "title", "description", "workplace_type", "short_description", "experience",
    "skills_required", "posted_date", "job_state", "apply_link", "country", "city",
    "company_name", "company_logo", "portal",
)
