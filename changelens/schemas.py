"""Schemas of change documents, annotations and ledgers; reads never infer them."""

_ACTOR = "struct<__typename:string,login:string,url:string>"
_FILE = "struct<path:string,additions:bigint,deletions:bigint,changeType:string>"
_COMMENT = f"struct<id:string,url:string,body:string,createdAt:string,author:{_ACTOR}>"
_HEAD = f"""id string, number bigint, url string, title string, body string, state string, createdAt string, updatedAt string, closedAt string,
mergedAt string, additions bigint, deletions bigint, changedFiles bigint, baseRefName string, baseRefOid string, headRefName string, headRefOid string,
reviewDecision string, author {_ACTOR}, mergedBy {_ACTOR}"""

#: Cross-repository change documents: the file list is an array, truncation is a map.
CHANGE_DOCUMENT = f"""{_HEAD},
repository struct<id:string,nameWithOwner:string,stargazerCount:bigint,primaryLanguage:struct<name:string>>,
labels struct<nodes:array<struct<name:string>>>, files array<{_FILE}>, commits array<struct<commit:struct<oid:string>>>,
comments array<{_COMMENT}>,
reviews array<struct<id:string,url:string,state:string,body:string,createdAt:string,submittedAt:string,author:{_ACTOR}>>,
reviewThreads array<struct<id:string,isResolved:boolean,isOutdated:boolean,path:string,line:bigint,comments:array<{_COMMENT}>>>,
searchMatches array<struct<agent:string,signal:string>>, selectionAssignments array<struct<cohort:string,agent:string,rank:bigint>>,
collection struct<collectedAt:string,collectionLimit:bigint,truncated:map<string,boolean>>"""

#: Census documents of one repository: files and labels are connection objects with counts.
CENSUS_DOCUMENT = f"""{_HEAD}, repository struct<nameWithOwner:string>,
labels struct<totalCount:bigint,nodes:array<struct<name:string>>>,
files struct<totalCount:bigint,pageInfo:struct<hasNextPage:boolean,endCursor:string>,nodes:array<{_FILE}>>"""

ANNOTATION = "id string, agent string, created_at string, url string, number bigint, status string, task_type string, phases array<string>, human_participation boolean, model string, input_hash string"
SELECTION = "cohort string, agent string, rank bigint, selected_at string, node_id string, repository string, number bigint, url string, created_at string"
SEARCH_WINDOW = "id string, agent string, signal string, repository string, start_at string, end_at string, status string, cursor string, issue_count bigint, fetched_count bigint, truncated boolean, error string, updated_at string"
REVIEW_LABEL = """status string, request_id string, input_hash string, pr_node_id string, labeled_at string,
classification struct<is_code_issue:boolean,categories:array<string>,severity:string,confidence:double,evidence_quote:string,rationale:string,normalizations:array<string>>, usage map<string,bigint>"""
