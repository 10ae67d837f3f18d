from clickgrain.functions.ranking import *  # noqa: F401,F403
from clickgrain.functions.scalars import *  # noqa: F401,F403
