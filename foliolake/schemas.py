"""Explicit schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

RIGHTS = "struct<status:string,basis:string,license:string,license_url:string>"
ASSETS = (
    "id string, title string, composer string, work_identifier string, source_url string, source_file string, "
    f"source_sha256 string, composition_rights {RIGHTS}, source_file_rights {RIGHTS}, verified_date string, notes string"
)
ASSET_MANIFEST = f"schema_version int, scores array<struct<{', '.join(c.replace(' ', ':', 1) for c in ASSETS.split(', '))}>>"
CATALOGUE = (
    "schema_version int, upstream struct<repository:string,commit:string,source_file_rights_basis:string>, "
    "scores array<struct<id:string,composer:string,death_year:int,work:string,path:string,coverage:string>>"
)
DATASET_METADATA = (
    "schema_version int, dataset_id string, sample_count bigint, source_splits map<string,string>, "
    "split_counts map<string,bigint>, skipped_page_count bigint, config string"
)
MARGINS = "struct<top:double,right:double,bottom:double,left:double>"
SAMPLES = (
    "schema_version int, sample_id string, dataset_id string, source_id string, source_path string, "
    "source_sha256 string, source_license_status string, "
    f"source_provenance struct<source_url:string,composition_rights:{RIGHTS},source_file_rights:{RIGHTS},verified_date:string>, "
    "page int, split string, generator_version string, lilypond_version string, seed bigint, render_id string, "
    "render_parameters struct<staff_size:double,paper_format:string,orientation:string,"
    f"margins_mm:{MARGINS},layout_seed:decimal(20,0),dpi:int,mask_threshold:double,strict_unknown_grobs:boolean>, "
    "degradation_preset string, "
    "degradations array<struct<order:int,family:string,seed:bigint,parameters:variant>>, "
    "input_path string, clean_target_path string, mask_paths map<string,string>, recipe_path string, "
    "hashes map<string,string>, dimensions struct<width:int,height:int>, dpi int, created_at string"
)
