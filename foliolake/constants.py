"""Fixed values that results depend on."""

# --- fixed values -----------------------------------------------------------------------------
SPLITS = ("train", "validation", "test", "challenge")
CLASSES = ("background", "staff", "notation", "text")
FOREGROUND = ("staff", "notation", "text")
TRAINABLE_CLASSES = ("staff", "notation")
DISTRIBUTABLE = ("public_domain", "compatible_license")
FAMILIES = ("blur", "gaussian_noise", "uneven_illumination", "jpeg", "stains")
MANIFEST_SCHEMA_VERSION = 1
REQUIRED_SAMPLE_FIELDS = (
    "clean_target_path",
    "created_at",
    "dataset_id",
    "degradation_preset",
    "degradations",
    "dimensions",
    "dpi",
    "generator_version",
    "hashes",
    "input_path",
    "lilypond_version",
    "mask_paths",
    "page",
    "recipe_path",
    "render_parameters",
    "sample_id",
    "schema_version",
    "seed",
    "source_id",
    "source_license_status",
    "source_path",
    "source_provenance",
    "source_sha256",
    "split",
)
REQUIRED_RENDER_FIELDS = (
    "dpi",
    "layout_seed",
    "margins_mm",
    "mask_threshold",
    "orientation",
    "paper_format",
    "staff_size",
    "strict_unknown_grobs",
)
REQUIRED_ASSET_TEXT = (
    "id",
    "title",
    "composer",
    "work_identifier",
    "source_url",
    "source_file",
    "source_sha256",
    "notes",
)
CATALOGUE_FIELDS = ("id", "composer", "death_year", "work", "path", "coverage")
ARTIFACT_ROLES = ("input", "clean", "recipe", "mask_background", "mask_staff", "mask_notation", "mask_text")
OVERLAY_COLOURS = {"staff": (45, 115, 255), "notation": (235, 55, 55), "text": (45, 170, 85)}
SSIM_C1 = (0.01 * 255) ** 2
SSIM_C2 = (0.03 * 255) ** 2
COMPARABLE_IGNORES = ("task", "model_backend", "pretrained", "freeze_batch_norm")
QUALITY_METRICS = (
    "cleaned_ink_fraction",
    "source_ink_retention",
    "cleaned_ink_from_source_fraction",
    "tiny_ink_components_per_megapixel",
    "staff_like_line_retention",
    "tile_seam_discontinuity",
    "tile_seam_ink_density_ratio",
)
INCLUDE_PATTERN = r'\\include\s+"([^"\\]+)"'
BUILTIN_INCLUDES = ("articulate.ly", "deutsch.ly", "english.ly", "italiano.ly", "nederlands.ly")
# Ranges per preset, family and field as (low, high).
PRESETS = {
    "light": {
        "operation_count": (1, 2),
        "blur": {"radius": (0.3, 0.8)},
        "gaussian_noise": {"sigma": (1.5, 4.0)},
        "uneven_illumination": {"strength": (0.03, 0.10), "grid_size": (3, 4)},
        "jpeg": {"quality": (82, 95)},
        "stains": {
            "opacity": (0.02, 0.08),
            "blob_count": (1, 3),
            "blob_radius_fraction": (0.006, 0.018),
            "speckle_density": (0.00002, 0.00008),
        },
    },
    "medium": {
        "operation_count": (2, 3),
        "blur": {"radius": (0.6, 1.4)},
        "gaussian_noise": {"sigma": (3.0, 8.0)},
        "uneven_illumination": {"strength": (0.08, 0.20), "grid_size": (3, 5)},
        "jpeg": {"quality": (60, 82)},
        "stains": {
            "opacity": (0.06, 0.18),
            "blob_count": (2, 7),
            "blob_radius_fraction": (0.008, 0.030),
            "speckle_density": (0.00008, 0.00030),
        },
    },
    "heavy": {
        "operation_count": (3, 5),
        "blur": {"radius": (1.0, 2.4)},
        "gaussian_noise": {"sigma": (7.0, 14.0)},
        "uneven_illumination": {"strength": (0.15, 0.32), "grid_size": (3, 6)},
        "jpeg": {"quality": (38, 65)},
        "stains": {
            "opacity": (0.12, 0.30),
            "blob_count": (5, 14),
            "blob_radius_fraction": (0.010, 0.045),
            "speckle_density": (0.00025, 0.00080),
        },
    },
    "random": {
        "operation_count": (1, 5),
        "blur": {"radius": (0.3, 2.4)},
        "gaussian_noise": {"sigma": (1.5, 14.0)},
        "uneven_illumination": {"strength": (0.03, 0.32), "grid_size": (3, 6)},
        "jpeg": {"quality": (38, 95)},
        "stains": {
            "opacity": (0.02, 0.30),
            "blob_count": (1, 14),
            "blob_radius_fraction": (0.006, 0.045),
            "speckle_density": (0.00002, 0.00080),
        },
    },
}
# --- end of fixed values ----------------------------------------------------------------------

# "custom" starts from the light ranges with one operation and every family switched off.
CUSTOM_BASE_PRESET = "light"
INTEGER_FIELDS = ("grid_size", "quality", "blob_count", "operation_count")
MICRO = 1_000_000

# What a config may ask for, per family and field (lowest, highest).
LIMITS = {
    "blur": {"radius": (0.0, 5.0)},
    "gaussian_noise": {"sigma": (0.0, 50.0)},
    "uneven_illumination": {"strength": (0.0, 0.5), "grid_size": (2, 12)},
    "jpeg": {"quality": (20, 100)},
    "stains": {
        "opacity": (0.0, 0.5), "blob_count": (0, 100), "blob_radius_fraction": (0.001, 0.1), "speckle_density": (0.0, 0.01),
    },
}
