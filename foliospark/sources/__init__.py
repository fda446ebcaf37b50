"""Where pages, images and documents come from."""
