"""Schemas of the library's tables."""

from __future__ import annotations

BBOX = "struct<x:float,y:float,w:float,h:float>"
OBJECT = f"struct<class_name:string,conf:float,bbox:{BBOX},mask_area:int,mask_path:string,mask_rle:array<array<bigint>>>"
FACE = f"struct<face_id:string,name:string,conf:float,bbox:{BBOX}>"

MEDIA_ROW = "id string, media_type string, file_name string, file_size bigint, file_sha256 string, file_phash string, meta_duration double, meta_fps double, meta_width int, meta_height int, meta_created_at string, meta_modified_at string, processed boolean, favorite boolean, is_hidden boolean, deleted_at string, thumbnail string"
MEDIA_OBJECTS = "media_id string, ord bigint, class_name string, conf float, x float, y float, w float, h float, thumbnail string, mask_area int, mask_path string, mask_rle string"
MEDIA_FACES = "media_id string, ord bigint, face_id string, name string, conf float, x float, y float, w float, h float"
PERSON = f"face_id string, name string, thumbnail string, conf float, face_bbox {BBOX}, created_at string"
EMBEDDING = "point_id string, media_id string, source string, frame_ts double, frame_idx bigint, vec array<float>"
SEARCH_HISTORY = "id bigint, query string, image_path string, filter_object string, filter_face string, filter_month int, filter_year int, filter_media_type string, created_at string, deleted_at string"
CUSTOM_ALBUM = "id string, title string, created_at string"
ALBUM_MEDIA = "album_id string, media_id string"
CONFIG = "id string, source_dir string, updated_at string"
FILE_LISTING = "path string, name string, size bigint, modified_at string, sha256 string"
FILE_EVENT = "path string, kind string, ts timestamp"
SCENE_CUT = "media_id string, frame_idx bigint, fps double, total_frames bigint"

TABLES = {"media": MEDIA_ROW, "media_objects": MEDIA_OBJECTS, "media_faces": MEDIA_FACES, "person": PERSON, "config": CONFIG, "search_history": SEARCH_HISTORY, "custom_album": CUSTOM_ALBUM, "album_media": ALBUM_MEDIA}
