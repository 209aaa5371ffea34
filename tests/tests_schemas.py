QUEUE = "id long, url string, domain string, priority int, depth int, status string, attempts int, needs_js boolean, queued_at timestamp, last_attempt_at timestamp"
PAGES = "id long, url string, domain string, title string, summary string, embedding array<float>, language string, status string, indexed_at timestamp, created_at timestamp, updated_at timestamp"
RULES = "domain string, blocked boolean, crawl_delay_ms int, last_crawled_at timestamp, robots_txt string"
CORPUS = "url string, http_status int, content_type string, fetch_error string, html string"
