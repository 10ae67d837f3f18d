from clickgrain.sources.readers import *  # noqa: F401,F403
from clickgrain.sources.schema import *  # noqa: F401,F403
from clickgrain.sources.writers import *  # noqa: F401,F403
