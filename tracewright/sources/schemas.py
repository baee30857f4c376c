"""Schemas of the tables (D1-D26) that the operators read."""

CALL_LOG = "ts string, tool string, source string, sid string, tag string, args array<string>, fp string, dur_ms bigint, exit bigint, err string, out_bytes bigint, out_tokens bigint, summary variant"
TRANSCRIPT = "type string, cwd string, gitBranch string, version string, sessionId string, timestamp string, durationMs bigint, isMeta boolean, isSidechain boolean, aiTitle string, messageCount int, prNumber int, prUrl string, message variant"
PACKAGE = "name string, version string, type string, `require` map<string,string>, `require-dev` map<string,string>, scripts map<string,variant>, autoload struct<`psr-4`:map<string,variant>>"
PULL_REQUEST = "dim string, repo string, is_fork boolean, number int, title string, is_draft boolean, review string, ci string, url string"
BRANCH = "repo string, archived boolean, default_branch string, name string, committed_date string, pr_number int, pr_state string"
RUN = "pkg string, id bigint, workflow string, status string, conclusion string, branch string, event string, title string, created string"
PRICES = "model string, input double, output double"
STATE = "sid string, fp string, ts bigint, tok bigint, force boolean"
