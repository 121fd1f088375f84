"""Where voxels come from."""
