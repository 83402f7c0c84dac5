"""Schemas of the catalogue's tables."""

PRODUCTS = (
    "id string, sku string, name string, brand string, category string, category_id string, description string, "
    "current_price decimal(12,2), original_price decimal(12,2), discount_percentage double, features array<string>, "
    "images array<string>, specifications map<string,string>, availability string, url string, "
    "scraped_at timestamp, created_at timestamp, updated_at timestamp"
)
PRICE_HISTORY = "id string, product_id string, price decimal(12,2), original_price decimal(12,2), discount_percentage double, recorded_at timestamp"
JOBS = (
    "id string, job_type string, status string, target_url string, total_items int, processed_items int, success_items int, "
    "failed_items int, error_message string, started_at timestamp, completed_at timestamp, created_at timestamp"
)
RAW_PAGE = (
    "url string, markdown string, html string, linksOnPage array<string>, "
    "metadata struct<title:string,description:string,sourceURL:string,url:string>, price string, current_price string, "
    "originalPrice string, original_price string, brand string, category string, description string, features_str string, "
    "features_arr array<string>, specifications map<string,string>, images_str string, images_arr array<string>, "
    "availability string, stock_status string"
)
JOB_TYPES = ["discovery", "product", "category", "search"]
JOB_STATUSES = ["pending", "running", "completed", "failed", "cancelled"]
AVAILABILITIES = ["in_stock", "out_of_stock", "unknown"]
