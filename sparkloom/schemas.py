"""Explicit schemas of all tables (nothing is inferred)."""

_VEC = "embedding array<float>, created_at timestamp_ntz, updated_at timestamp_ntz"
EXPERIENCES = f"id bigint, company string, role string, mission_type string, start_date date, end_date date, duration_months int, location string, context string, technologies array<string>, {_VEC}"
PROJECTS = f"id bigint, experience_id bigint, name string, description string, objective string, problem string, solution string, results string, impact string, stack string, start_date date, end_date date, duration_months int, collaborators string, project_type string, {_VEC}"
FORMATIONS = f"id bigint, institution string, degree string, field string, start_date date, end_date date, location string, description string, key_learnings string, {_VEC}"
INFORMATIONS = f"id bigint, nom string, prenom string, prononciation string, date_naissance date, pays_naissance string, location string, passion string, {_VEC}"
SKILLS = "id bigint, name string, category string, proficiency_level string, created_at timestamp_ntz"
EXPERIENCE_SKILLS = "experience_id bigint, skill_id bigint"
PROJECT_SKILLS = "project_id bigint, skill_id bigint"
CHAT_SESSIONS = "id bigint, session_id string, user_identifier string, created_at timestamp_ntz, question_count int, total_tokens int, total_cost decimal(10,6), avg_latency_ms int, providers_used map<string,bigint>"
CHAT_MESSAGES = "id bigint, session_id string, role string, content string, tokens_used int, created_at timestamp_ntz"
RETRIEVAL_LOGS = (
    "id bigint, query_id string, session_id string, query_text string, retrieved_chunks array<struct<id:bigint,type:string,score:double>>, retrieval_method string, latency_ms int, "
    "created_at timestamp_ntz, nb_chunks_retrieved int, llm_provider string, embedding_tokens int, llm_tokens int, embedding_cost decimal(10,6), llm_cost decimal(10,6), total_cost decimal(10,6), "
    "latency_retrieval_ms int, latency_generation_ms int, latency_total_ms int"
)
FEEDBACK_LOGS = "id bigint, query_id string, thumbs_up boolean, comment string, created_at timestamp_ntz"
CV_FILES = "id bigint, filename string, content_type string, file_data binary, uploaded_at timestamp_ntz"
CV_PAGES = "id bigint, page_number int, image_data binary, width int, height int, created_at timestamp_ntz"
SCHEMA_MIGRATIONS = "id bigint, filename string, applied_at timestamp_ntz"
EMBEDDINGS_CACHE = "md5 string, model string, embedding array<float>"

_PROJECT = "struct<name:string,description:string,objective:string,problem:string,solution:string,results:string,impact:string,stack:string,start_date:string,end_date:string,duration_months:int,collaborators:string,project_type:string,skills:array<string>>"
#: Nested JSON inputs. Skills mix strings and objects, so they are read as raw JSON strings.
EXPERIENCES_JSON = f"company string, role string, mission_type string, start_date string, end_date string, duration_months int, location string, context string, technologies array<string>, skills array<string>, projects array<{_PROJECT}>"
FORMATIONS_JSON = "institution string, degree string, field string, start_date string, end_date string, location string, description string, key_learnings string"
INFORMATIONS_JSON = "nom string, prenom string, prononciation string, date_naissance string, pays_naissance string, location string, passion string"

TABLES = {k.lower(): v for k, v in list(globals().items()) if k.isupper() and not k.startswith("_") and not k.endswith("_JSON")}
