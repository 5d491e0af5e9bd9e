"""Fixed dimensions: artifact types, weights, call catalogues and what the platform itself owns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# These must equal the published ones for right results.

#: Artifact type and the manifest group that lists it.
GROUPS = {
    "option": "options", "table": "tables", "cron": "cron", "transient": "transients",
    "post_meta": "post_meta", "user_meta": "user_meta", "term_meta": "term_meta", "comment_meta": "comment_meta",
    "role": "roles", "capability": "capabilities", "post_type": "post_types", "taxonomy": "taxonomies",
    "directory": "directories", "rewrite_rule": "rewrite_rules", "action": "actions", "dropin": "dropins", "muplugin": "muplugins",
}

#: What an artifact that is left behind costs; options by autoload.
WEIGHTS = {
    "table": 15, "cron": 12, "transient": 3, "post_type": 15, "taxonomy": 9, "post_meta": 10, "user_meta": 8, "term_meta": 6,
    "comment_meta": 6, "role": 8, "capability": 5, "action": 12, "dropin": 16, "muplugin": 14, "directory": 7, "rewrite_rule": 2,
}
OPTION_WEIGHTS = {"yes": 18, "unknown": 8}
OTHER_WEIGHT = 4
CEILINGS = {"A": 100, "B": 90, "C": 85, "D": 65, "F": 49}
MINOR_LEFTOVERS = 5
CONDITIONAL_SCORE = 90
#: Types that a deactivation hook is credited for.
DEACTIVATION_TYPES = ("cron", "action", "transient", "rewrite_rule")
CONFIDENT = ("verified", "resolved")

#: The `via` of removals whose key is a pattern over the keys that a bulk delete removes.
LIKE, LIKE_NETWORK = "wpdb::query like", "wpdb::query like sitemeta"

#: Core tables with keyed rows: key column, artifact type, whether network-wide.
KEYED_ROWS = {
    "{prefix}options": ("option_name", "option", False),
    "{prefix}sitemeta": ("meta_key", "option", True),
    "{prefix}postmeta": ("meta_key", "post_meta", False),
    "{prefix}usermeta": ("meta_key", "user_meta", False),
    "{prefix}termmeta": ("meta_key", "term_meta", False),
    "{prefix}commentmeta": ("meta_key", "comment_meta", False),
}

#: Directories of a source tree that are never read.
SKIPPED_DIRECTORIES = ("vendor", "node_modules", "tests", "test", "dist", "build", ".git", ".github")

#: Path roots: constant or function that names one, and its portable token.
ROOT_TOKENS = {
    "WP_CONTENT_DIR": "{content_dir}", "WPMU_PLUGIN_DIR": "{mu_plugins}", "WP_PLUGIN_DIR": "{plugin_dir}", "ABSPATH": "{abspath}",
}
DROPINS = (
    "advanced-cache.php", "db.php", "db-error.php", "install.php", "maintenance.php", "object-cache.php", "php-error.php",
    "fatal-error-handler.php", "sunrise.php", "blog-deleted.php", "blog-inactive.php", "blog-suspended.php",
)

#: Keys that the platform owns, by type; compared as they are, but for tables and directories (lower case).
CORE = {
    "option": """
        siteurl home blogname blogdescription users_can_register admin_email start_of_week use_balanceTags use_smilies
        require_name_email comments_notify posts_per_rss rss_use_excerpt mailserver_url mailserver_login mailserver_pass
        mailserver_port default_category default_comment_status default_ping_status default_pingback_flag posts_per_page
        date_format time_format links_updated_date_format comment_moderation moderation_notify permalink_structure
        rewrite_rules hack_file blog_charset moderation_keys active_plugins category_base ping_sites comment_max_links
        gmt_offset default_email_category recently_edited template stylesheet comment_registration html_type use_trackback
        default_role db_version initial_db_version uploads_use_yearmonth_folders upload_path blog_public
        default_link_category show_on_front tag_base sidebars_widgets cron sticky_posts WPLANG timezone_string
        page_for_posts page_on_front default_post_format link_manager_enabled site_icon wp_page_for_privacy_policy
        admin_email_lifespan disallowed_keys comment_previously_approved auto_update_core_dev auto_update_core_minor
        auto_update_core_major wp_force_deactivated_plugins fresh_site blogimage
        {prefix}user_roles wp_user_roles user_roles uninstall_plugins recently_activated category_children
        can_compress_scripts db_upgraded https_migration_required thumbnail_size_w thumbnail_size_h medium_size_w
        medium_size_h large_size_w large_size_h medium_large_size_w medium_large_size_h avatar_default avatar_rating
        nav_menu_options theme_switched finished_splitting_shared_terms user_count
        comments_per_page page_comments thread_comments thread_comments_depth show_avatars close_comments_for_old_posts
        close_comments_days_old comment_order default_comments_page show_comments_cookies_opt_in image_default_align
        image_default_size image_default_link_type thumbnail_crop embed_autourls embed_size_w embed_size_h current_theme
        upload_url_path wp_attachment_pages_enabled active_sitewide_plugins
        widget_archives widget_block widget_calendar widget_categories widget_custom_html widget_media_audio
        widget_media_gallery widget_media_image widget_media_video widget_meta widget_nav_menu widget_pages
        widget_recent-comments widget_recent-posts widget_rss widget_search widget_tag_cloud widget_text
    """,
    "post_meta": """
        _edit_lock _edit_last _thumbnail_id _wp_page_template _wp_attached_file _wp_attachment_metadata
        _wp_attachment_image_alt _wp_old_slug _wp_old_date _wp_trash_meta_status _wp_trash_meta_time
        _wp_desired_post_slug _wp_attachment_backup_sizes _wp_attachment_context _encloseme _pingme _menu_item_type
        _menu_item_menu_item_parent _menu_item_object_id _menu_item_object _menu_item_target _menu_item_classes
        _menu_item_xfn _menu_item_url
    """,
    "user_meta": """
        first_name last_name nickname description rich_editing syntax_highlighting comment_shortcuts admin_color use_ssl
        show_admin_bar_front locale {prefix}capabilities {prefix}user_level dismissed_wp_pointers show_welcome_panel
        session_tokens default_password_nag {prefix}dashboard_quick_press_last_post_id community-events-location
    """,
    "role": "administrator editor author contributor subscriber",
    "capability": """
        switch_themes edit_themes activate_plugins edit_plugins edit_users edit_files manage_options moderate_comments
        manage_categories manage_links upload_files import unfiltered_html edit_posts edit_others_posts
        edit_published_posts publish_posts edit_pages read edit_others_pages edit_published_pages publish_pages
        delete_pages delete_others_pages delete_published_pages delete_posts delete_others_posts delete_published_posts
        delete_private_posts edit_private_posts read_private_posts delete_private_pages edit_private_pages
        read_private_pages delete_users create_users unfiltered_upload edit_dashboard update_plugins delete_plugins
        install_plugins update_themes install_themes update_core list_users remove_users promote_users
        edit_theme_options delete_themes export customize delete_site manage_network manage_sites manage_network_users
        manage_network_plugins manage_network_themes manage_network_options upgrade_network setup_network create_sites
        delete_sites level_0 level_1 level_2 level_3 level_4 level_5 level_6 level_7 level_8 level_9 level_10
    """,
    "post_type": """
        post page attachment revision nav_menu_item custom_css customize_changeset oembed_cache user_request wp_block
        wp_template wp_template_part wp_global_styles wp_navigation wp_font_family wp_font_face
    """,
    "taxonomy": "category post_tag nav_menu link_category post_format wp_theme wp_template_part_area wp_pattern_category",
    "table": """
        {prefix}posts {prefix}postmeta {prefix}comments {prefix}commentmeta {prefix}terms {prefix}termmeta
        {prefix}term_relationships {prefix}term_taxonomy {prefix}links {prefix}options {prefix}users {prefix}usermeta
        {prefix}blogs {prefix}blogmeta {prefix}site {prefix}sitemeta {prefix}signups {prefix}registration_log
        {prefix}blog_versions
    """,
    "cron": """
        wp_version_check wp_update_plugins wp_update_themes wp_scheduled_delete wp_scheduled_auto_draft_delete
        delete_expired_transients recovery_mode_clean_expired_keys wp_privacy_delete_old_export_files
        wp_https_detection wp_update_user_counts wp_site_health_scheduled_check do_pings publish_future_post
        importer_scheduled_cleanup wp_maybe_auto_update wp_split_shared_term_batch wp_delete_temp_updater_backups
        wp_update_comment_type_batch
    """,
    "directory": """
        {content_dir} {content_dir}/uploads {content_dir}/plugins {content_dir}/themes {content_dir}/mu-plugins
        {content_dir}/upgrade {content_dir}/languages {content_dir}/upgrade-temp-backup {plugin_dir} {abspath}
        {abspath}/wp-admin {abspath}/wp-includes
    """,
}
CORE_OPTION_PREFIX = "theme_mods_"

#: Write calls whose key is one argument: function, type, key's place, its parameter name, autoload's place, and what it is when absent.
WRITES = [
    ("add_option", "option", 0, "option", 3, "yes"), ("update_option", "option", 0, "option", 2, "unknown"),
    ("add_site_option", "option", 0, "option", None, None), ("update_site_option", "option", 0, "option", None, None),
    ("add_network_option", "option", 1, "option", None, None), ("update_network_option", "option", 1, "option", None, None),
    ("set_transient", "transient", 0, "transient", None, None), ("set_site_transient", "transient", 0, "transient", None, None),
    ("add_post_meta", "post_meta", 1, "meta_key", None, None), ("update_post_meta", "post_meta", 1, "meta_key", None, None),
    ("add_user_meta", "user_meta", 1, "meta_key", None, None), ("update_user_meta", "user_meta", 1, "meta_key", None, None),
    ("add_term_meta", "term_meta", 1, "meta_key", None, None), ("update_term_meta", "term_meta", 1, "meta_key", None, None),
    ("add_comment_meta", "comment_meta", 1, "meta_key", None, None), ("update_comment_meta", "comment_meta", 1, "meta_key", None, None),
    ("register_post_type", "post_type", 0, "post_type", None, None), ("register_taxonomy", "taxonomy", 0, "taxonomy", None, None),
    ("add_role", "role", 0, "role", None, None),
]
#: Scheduling calls: function, type, key's place, its parameter name, recurrence (a place or a word), arguments' place.
SCHEDULES = [
    ("wp_schedule_event", "cron", 2, "hook", 1, 3), ("wp_reschedule_event", "cron", 2, "hook", 1, 3),
    ("wp_schedule_single_event", "cron", 1, "hook", "single", 2),
    ("as_schedule_recurring_action", "action", 2, "hook", 1, 3), ("as_schedule_single_action", "action", 1, "hook", "single", 2),
    ("as_schedule_cron_action", "action", 2, "hook", 1, 3), ("as_enqueue_async_action", "action", 0, "hook", "async", 1),
]
REWRITES = [("add_rewrite_rule", 0, "regex"), ("add_rewrite_endpoint", 0, "name"), ("add_rewrite_tag", 0, "tag")]
#: Removal calls: function, type, key's place, its parameter name.
REMOVALS = [
    ("delete_option", "option", 0, "option"), ("delete_site_option", "option", 0, "option"), ("delete_network_option", "option", 1, "option"),
    ("delete_transient", "transient", 0, "transient"), ("delete_site_transient", "transient", 0, "transient"),
    ("wp_clear_scheduled_hook", "cron", 0, "hook"), ("wp_unschedule_hook", "cron", 0, "hook"), ("wp_unschedule_event", "cron", 1, "hook"),
    ("delete_post_meta", "post_meta", 1, "meta_key"), ("delete_user_meta", "user_meta", 1, "meta_key"),
    ("delete_term_meta", "term_meta", 1, "meta_key"), ("delete_comment_meta", "comment_meta", 1, "meta_key"),
    ("delete_post_meta_by_key", "post_meta", 0, "post_meta_key"), ("remove_role", "role", 0, "role"),
    ("as_unschedule_all_actions", "action", 0, "hook"), ("as_unschedule_action", "action", 0, "hook"), ("rmdir", "directory", 0, "directory"),
]
#: Autoload arguments, by what they come to.
AUTOLOAD = {"true": "yes", "yes": "yes", "on": "yes", "auto": "yes", "auto-on": "yes", "false": "no", "no": "no", "off": "no", "auto-off": "no"}


def core_sets() -> dict[str, set[str]]:
    """Core keys by type."""
    return {kind: set(text.split()) for kind, text in CORE.items()}


def core(spark: SparkSession) -> DataFrame:
    """core_type, core_key: a few hundred fixed rows, for broadcast."""
    rows = [(kind, key) for kind, keys in core_sets().items() for key in sorted(keys)]
    return spark.createDataFrame(rows, "core_type string, core_key string")


def network_call(function: Column) -> Column:
    """Whether a call acts on the whole network."""
    name = F.lower(function)
    return F.coalesce(name.contains("site_option") | name.contains("network_option") | name.contains("site_transient"), F.lit(False))


def scope(function: Column) -> Column:
    return F.when(network_call(function), "network").otherwise("site")


def confident(confidence: Column) -> Column:
    return confidence.isin(*CONFIDENT)


def autoload_rank(autoload: Column) -> Column:
    """yes 2, unknown 1, no and null 0."""
    return F.when(autoload == "yes", 2).when(autoload == "unknown", 1).otherwise(0)


def weight(kind: Column, autoload: Column) -> Column:
    """What leaving the artifact behind costs."""
    option = reduce(lambda e, x: e.when(autoload == x[0], x[1]), OPTION_WEIGHTS.items(), F.when(F.lit(False), 0)).otherwise(OTHER_WEIGHT)
    return reduce(lambda e, x: e.when(kind == x[0], x[1]), WEIGHTS.items(), F.when(kind == "option", option)).otherwise(OTHER_WEIGHT)


def group_of(kind: Column) -> Column:
    """The manifest group of a type; null for an unknown one."""
    return F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))[kind]


def core_key(kind: Column, key: Column) -> Column:
    """A key in the form that core keys are compared in."""
    return F.when(kind == "table", F.lower(key)).when(kind == "directory", F.regexp_replace(F.lower(key), "/+$", "")).otherwise(key)
