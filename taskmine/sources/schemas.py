"""Schemas of landed files (DDL strings) and of stored records."""

SEARCH_ITEM = (
    "struct<full_name:string,stargazers_count:bigint,size:bigint,topics:array<string>,"
    "language:string,archived:boolean,disabled:boolean,fork:boolean>"
)
SEARCH_PAGE = f"page bigint, total_count bigint, items array<{SEARCH_ITEM}>"

REPOSITORY_DETAIL = (
    "full_name string, stargazers_count bigint, size bigint, topics array<string>, "
    "language string, archived boolean, disabled boolean, fork boolean"
)
CRAWL_LIST = "map<string,array<string>>"

RELEASE = (
    "repo string, api_pos bigint, tag_name string, name string, body string, "
    "published_at string, target_commitish string, author struct<login:string>"
)

REPOSITORY_FILE = "repo string, pos bigint, path string, type string, download_url string, content string"

_CHANGES = "array<struct<description:string,pr_ids:array<string>>>"
RELEASE_ANSWER = (
    f"struct<new_features:{_CHANGES},improvements:{_CHANGES},"
    f"bug_fixes:{_CHANGES},other_changes:{_CHANGES}>"
)

PULL_REQUEST = (
    "repo string, pr_number string, title string, body string, state string, "
    "merged boolean, base struct<sha:string>, head struct<sha:string>"
)
FILE_CHANGE = (
    "struct<filename:string,status:string,additions:bigint,deletions:bigint,"
    "changes:bigint,patch:string>"
)
PULL_REQUEST_FILES = f"array<{FILE_CHANGE}>"

COMMIT = (
    "repo string, sha string, "
    "commit struct<message:string,author:struct<date:string,name:string>>"
)
COMMIT_RECORD = "struct<sha:string,message:string,date:string,author:string>"

FILE_CONTENT = "repo string, path string, ref string, encoding string, content string"

PR_ANALYSIS = (
    "struct<pr_number:string,repo_name:string,title:string,description:string,state:string,"
    f"merged:boolean,base_commit:{COMMIT_RECORD},head_commit:{COMMIT_RECORD},"
    f"file_changes:array<{FILE_CHANGE}>,detailed_description:string,has_tests:boolean,"
    "test_files:array<string>,only_modified_existing_functions:boolean,"
    "non_test_files:array<string>,analyzed_at:string>"
)
ENHANCED_FEATURE = (
    "struct<feature_type:string,description:string,"
    f"pr_analyses:array<{PR_ANALYSIS}>,feature_detailed_description:string>"
)
_FEATURES = "array<struct<feature_type:string,description:string,pr_links:array<string>>>"
RELEASE_ANALYSIS = (
    f"struct<tag_name:string,repo_name:string,new_features:{_FEATURES},improvements:{_FEATURES},"
    f"bug_fixes:{_FEATURES},other_changes:{_FEATURES},processed_body:string,analyzed_at:string>"
)
_RESULT_FIELDS = {
    "repository": "string", "release": "string", "analyzed_at": "string",
    "enhanced_new_features": f"array<{ENHANCED_FEATURE}>", "original_analysis": RELEASE_ANALYSIS,
}
RESULT_RECORD = ", ".join(f"{name} {kind}" for name, kind in _RESULT_FIELDS.items())
FINAL_RESULT = f"seq bigint, {RESULT_RECORD}"

TASK_SPEC = (
    "repo string, instance_id string, base_commit string, "
    f"patch array<{FILE_CHANGE}>, test_patch array<{FILE_CHANGE}>, problem_statement string, "
    "hints_text string, created_at string, version string, org string, number bigint, "
    "PASS_TO_PASS string, FAIL_TO_PASS string, test_files array<string>, processed boolean"
)

AGENT_PATCH = "instance_id string, model_patch string"

TEST_LOG = "repo string, instance_id string, phase string, log string"

EVALUATION = (
    "agent string, model string, instance_id string, success_f2p boolean, success_p2p boolean, "
    "success boolean, passed_f2p_tests array<string>, passed_p2p_tests array<string>, "
    "expected_f2p_tests array<string>, expected_p2p_tests array<string>, total_tokens bigint, "
    "patch_application struct<total_files_num:bigint,applied_files_num:bigint,"
    "applied_files:array<string>,patch_content:string>, error string"
)
