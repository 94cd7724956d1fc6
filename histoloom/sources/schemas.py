"""Schemas of the source tables. Reading is tolerant: absent columns are filled, extra ones are left out."""

from __future__ import annotations

# Table to DDL.
SCHEMAS = {
    "commit_info": "hash string, commit_type string, commit_label string, repo_url string, msg string, author string, author_date timestamp, author_timezone int, committer string, committer_date timestamp, committer_timezone int, in_main_branch boolean, merge boolean, parents string, num_lines_deleted double, num_lines_added double, num_lines_changed double, num_files_changed double, dmm_unit_size double, dmm_unit_complexity double, dmm_unit_interfacing double, cwe_id string",
    "commit_features": "hash string, has_sdlc_data double, prev_tag_name string, repo_commits_last_30d double, repo_commits_last_90d double, repo_active_authors_90d double, issue_open_30d double, issue_open_90d double, issue_open_180d double, issue_age_median double, issues_closed_last_90d double, issues_closed_last_180d double, issue_open_velocity_30d double, issue_open_velocity_90d double, pr_count_30d double, pr_count_90d double, pr_count_180d double, pr_age_median double, pr_closed_last_90d double, pr_closed_last_180d double, pr_open_velocity_30d double, pr_open_velocity_90d double, days_since_prev_tag double, tags_last_180d double, tags_last_365d double, avg_release_cadence_days double, days_since_prev_tag_norm double, dev_experience_days double, dev_commits_before double, dev_is_new_contributor double, pr_to_issue_open_ratio_90d double, issue_to_pr_closed_ratio_90d double, has_issue_pr_gap double, activity_since_last_tag double",
    "file_info": "hash string, commit_label string, filename string, old_path string, new_path string, change_type string, num_lines_added double, num_lines_deleted double, num_method_changed double, num_lines_of_code double, complexity double, token_count double",
    "function_info": "hash string, commit_label string, name string, filename string, num_lines_of_code double, complexity double, token_count double, length double, top_nesting_level double, start_line int, end_line int, parameters string, before_change boolean, function_change_type string",
    "hunk_info": "hash string, name string, filename string, complexity double, token_count double",
    "issue_info": "issue_id string, fc_hash string, vcc_hash string, opened_by_dev_id string, created_at timestamp, closed_at timestamp, labels string, window_since timestamp, window_until timestamp, matched_anchor string",
    "pull_request_info": "pr_id string, fc_hash string, vcc_hash string, pr_url string, opened_by_dev_id string, closed_by_dev_id string, created_at timestamp, closed_at timestamp, state string, title string, window_since timestamp, window_until timestamp, matched_anchor string",
    "release_tag_info": "tag_id string, tag_name string, fc_hash string, vcc_hash string, created_at timestamp, window_since timestamp, window_until timestamp, matched_anchor string",
    "developer_info": "commit_hash string, dev_email string, total_commits double, repo_total_commits_before double, repo_active_weeks_before double, repo_tenure_days double, repo_commits_as_committer_before double, recent_commits_90d double, time_since_last_commit_days double, experience_percentile_in_repo double, cross_repo_commits_before double, num_repos_contributed_before double",
    "commit_author": "commit_hash string, role string, dev_id string",
    "ownership_window": "commit_hash string, file_path string, dev_email string, ownership_ratio double, lines_owned double, edits_in_window double, total_lines double, window_days int",
    "cve_mapping": "cve_id string, cwe_id string, repo_url string, fc_hash string, vcc_hash string",
}
