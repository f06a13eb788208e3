"""sparkmoment: video-evidence analytics as plain PySpark DataFrame operators."""
